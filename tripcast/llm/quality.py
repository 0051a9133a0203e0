"""Operator 6, quality rules: counted rules and a hashed n-gram logistic regression.

Base rules count words, symbols, repeated lines and repeated 5-word windows of
the whole text. The classifier is a logistic regression over four hashed
families: words, word pairs, byte 3-grams and byte 5-grams, each as shares of
its row. It is fitted on labelled rows, its logits are calibrated on held-out
rows (Platt scaling), and every row is scored in Arrow batches against the
fixed ``THRESHOLD``.

Scale: scoring is one map without a shuffle. The fit uses the ``train_rows``
labelled rows with the smallest id hashes (a documented bound, the same at every
size); their texts meet in one task of bounded size and only the weights (a
fixed number) come back to the driver.

Defined cases: null text is empty (no words: base rule fails); without labels of
both classes the base rules decide alone; repeated rows get equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import id_and_text, prepare, utf8

BITS = 15
FAMILIES = 4
TRAIN_ROWS = 2_000
#: A row is kept if its calibrated probability of good quality reaches this.
THRESHOLD = 0.5
EPOCHS = 80
FIT_SLICE = 100
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, probability double")


def counts(raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every row."""
    starts, ends, words = tb.word_spans(raw, bounds, tb.NOT_SPACE)
    chars = tb.NOT_SPACE[raw] & ((raw & 0xC0) != 0x80)
    prefix = tb.Prefix(raw)
    # lines: split at \n, compared as they are, only those with a word
    newline = np.flatnonzero(raw == 10)
    line_start = np.union1d(bounds[:-1], newline + 1)
    line_start = line_start[line_start < len(raw)]
    line_end = np.minimum(np.append(line_start[1:], len(raw)), len(raw))
    is_cut = np.zeros(len(raw) + 1, bool)
    is_cut[newline + 1] = True
    is_cut[bounds] = False  # a row's own end, unless its last byte is a newline
    ends_in_newline = bounds[1:][(np.diff(bounds) > 0)]
    is_cut[ends_in_newline[raw[ends_in_newline - 1] == 10]] = True
    stop = line_end - is_cut[line_end]
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, line_start)
    line_start, stop = line_start[has_word], stop[has_word]
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    _, later = tb.repeated_in_row(prefix.stretches(line_start, stop), line_row)
    # 5-word windows found twice or more in their row
    word_hash = prefix.stretches(starts, ends)
    ok = np.flatnonzero(tb.window_starts(words, 5))
    row = tb.row_of(words)
    again, _ = tb.repeated_in_row(tb.Prefix(word_hash).windows(5)[ok] if len(ok) else np.zeros(0, np.uint64), row[ok])
    repeat = tb.covered(ok[again], 5, len(starts)) if len(starts) else np.zeros(0, bool)
    return {
        "n_words": np.diff(words), "word_chars": tb.per_row(chars, bounds), "n_symbols": tb.per_row(_SYMBOLS[raw], bounds),
        "n_dup_lines": np.bincount(line_row[later], minlength=len(bounds) - 1).astype(np.int64),
        "n_repeat_words": tb.per_row(repeat, words), "_word_hash": word_hash, "_words": words,
    }


def _grams(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds) of the byte k-grams of every row."""
    m = max(0, len(raw) - k + 1)
    code = np.zeros(m, np.uint64)
    for j in range(k):
        code |= raw[j: j + m].astype(np.uint64) << np.uint64(8 * j)
    slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
    ok = tb.window_starts(bounds, k)[:m]
    size = np.maximum(np.diff(bounds) - k + 1, 0)
    return slot[ok], np.concatenate([[0], np.cumsum(size)])


def families(raw: np.ndarray, bounds: np.ndarray, word_hash: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family: bucket of every occurrence, and its row bounds."""
    shift = np.uint64(64 - BITS)
    single = (word_hash >> shift).astype(np.int32)
    two = tb.window_starts(words, 2) if len(word_hash) else np.zeros(0, bool)
    pairs = (tb.Prefix(word_hash).windows(2) >> shift).astype(np.int32) if len(word_hash) > 1 else np.zeros(0, np.int32)
    pair_bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(words) - 1, 0))])
    return [(single, words), (pairs[two[: len(pairs)]], pair_bounds), _grams(raw, bounds, 3), _grams(raw, bounds, 5)]


@dataclass
class Model:
    weights: np.ndarray  # FAMILIES x 2**BITS
    bias: float
    scale: float  # Platt
    shift: float

    def probability(self, fams: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        z = np.full(n, float(self.bias))
        for w, (slot, at) in zip(self.weights, fams):
            sums = np.concatenate([[0.0], np.cumsum(w[slot], dtype=np.float64)])
            size = np.diff(at)
            z += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))


def fit(texts: list[str], good: np.ndarray, epochs: int = EPOCHS) -> Model | None:
    """Full-batch logistic regression (Adam), then Platt scaling on every fifth row, held out."""
    if len(set(good.tolist())) < 2:
        return None
    rows, slots, values = [], [], []
    for start in range(0, len(texts), FIT_SLICE):  # texts of a slice at a time: only shares of buckets are kept
        raw, bounds = utf8(pa.array(texts[start: start + FIT_SLICE], pa.large_string()))
        c = counts(raw, bounds)
        for f, (slot, at) in enumerate(families(raw, bounds, c["_word_hash"], c["_words"])):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            key, n = np.unique(row << BITS | slot, return_counts=True)
            r = key >> BITS
            rows.append((r + start).astype(np.int32))
            slots.append(((key & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32))
            values.append((n / np.maximum(np.diff(at), 1)[r]).astype(np.float32))
    row, slot, value = map(np.concatenate, (rows, slots, values))
    del rows, slots, values
    held = np.arange(len(texts)) % 5 == 4
    share = good[~held].mean() if (~held).any() else 0.5
    if not 0 < share < 1:
        return None
    weight = np.where(held, 0, np.where(good == 1, 0.5 / share, 0.5 / (1 - share)))
    weight = weight / max(weight.sum(), 1)
    w = np.zeros(FAMILIES << BITS)
    bias, first, second, b1, b2 = 0.0, np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(texts)
    for t in range(1, epochs + 1):
        z = bias + np.bincount(row, w.astype(np.float32)[slot] * value, n)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - good)
        grad = np.bincount(slot, err.astype(np.float32)[row] * value, len(w)) + 1e-7 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 1.0 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * err.sum(), 0.99 * b2 + 0.01 * err.sum() ** 2
        bias -= 0.1 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    z = bias + np.bincount(row, w.astype(np.float32)[slot] * value, n)
    pick = held if len(set(good[held].tolist())) == 2 else ~held
    scale, shift = _platt(z[pick], good[pick])
    return Model(w.reshape(FAMILIES, -1).astype(np.float32), float(bias), scale, shift)


def _platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(good) over logits, with Platt's smoothed targets, by Newton steps."""
    pos, neg = (good == 1).sum(), (good == 0).sum()
    target = np.where(good == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z / max(1e-9, np.abs(z).mean()), np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target))
        theta = theta - step * min(1, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / max(1e-9, np.abs(z).mean())), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model | None:
    """Fit on the ``train_rows`` labelled ids with the smallest hashes (one text for an id that repeats)."""
    picked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("good"))
              .where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.max("good").alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = (id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")  # at most train_rows rows
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("good").alias("good")))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        model = fit(frame["text"].tolist(), frame["good"].to_numpy(), epochs)
        if model is None:
            return pd.DataFrame({"weights": [], "bias": [], "scale": [], "shift": []})
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias], "scale": [model.scale], "shift": [model.shift]})

    found = rows.withColumn("whole", F.lit("all")).groupBy("whole").applyInPandas(one, "weights binary, bias double, scale double, shift double").collect()
    if not found:
        return None
    m = found[0]
    return Model(np.frombuffer(bytes(m["weights"]), np.float32).reshape(FAMILIES, -1), m["bias"], m["scale"], m["shift"])


def verdicts(column: pa.Array, model: Model | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(counts, base rule failed, probability of good quality) of every text."""
    raw, bounds = utf8(column)
    c = counts(raw, bounds)
    n = len(bounds) - 1
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return c, failed, model.probability(families(raw, bounds, c["_word_hash"], c["_words"]), n) if model else np.ones(n)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, probability and final verdict of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, failed, p = verdicts(batch.column(1), model)
            cols = [batch.column(0), *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    prepare(docs.sparkSession)
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the classifier, with all their columns."""
    prepare(docs.sparkSession)
    model = train(docs, labels, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, failed, p = verdicts(batch.column(at), model)
            yield batch.filter(pa.array(~failed & (p >= threshold)))

    return docs.mapInArrow(run, docs.schema)
