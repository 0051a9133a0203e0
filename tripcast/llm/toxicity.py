"""Operator 11, toxicity: averaged subword embeddings under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (3 to 5, with word
marks) and of the word itself, all hashed to ``2**BITS`` rows. A
text is read as windows of ``WINDOW`` words, without words that just occurred; a
window is the mean of its words (a short one is filled up with empty words),
followed by a linear softmax over (clean, toxic). Embeddings and softmax are
trained together in numpy (Adagrad). A misspelling that training never saw still
shares most n-gram vectors with the word it stands for. A text scores as its most
toxic window does, so one insult in a long text is not averaged away; Platt
scaling on held-out rows makes that a probability.

Training sees labels of texts, not of windows: first every window of a toxic text
counts as toxic, then only those that the model itself finds toxic (at least the
best one of each text) do.

Scale: scoring is one map without a shuffle over whole texts. The softmax of a
mean needs one number a bucket (the difference of the two outputs), so workers get
``2**BITS`` floats at any input size. The fit uses the ``train_rows`` labelled ids
of each class with the smallest id hashes (a documented bound) in one task.

Defined cases: null text is empty and scores as a window of no words; without
labels of both classes every score is 0.5 (predicted 1 under the rule score >= 0.5
would be a guess, so the score then is just below it); repeated rows get equal
results; a null id has no fold (``held_out`` null); an empty table gives no rows;
other columns are ignored.
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
from .quality import _platt

BITS = 16
DIM = 8
SIZES = (3, 4, 5)
WINDOW, STEP = 8, 4
#: Labelled rows of each class that the fit may read.
TRAIN_ROWS = 3_000
EPOCHS = (1, 2)
RATE = 1.0
BATCH = 1024
FOLDS = 5
THRESHOLD = 0.5
#: Score of everything when there is nothing to learn from.
UNKNOWN = float(np.nextafter(0.5, 0))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Words:
    """Distinct words of a batch: hashed n-grams of each (flat, with bounds), and the word of every occurrence."""

    grams: np.ndarray
    bounds: np.ndarray
    of: np.ndarray  # occurrence -> distinct word
    rows: np.ndarray  # bounds of rows over occurrences


def words_of(column: pa.Array) -> Words:
    raw, bounds = utf8(column)
    raw = tb.LOWER[raw]
    starts, ends, rows = tb.word_spans(raw, bounds, tb.ALNUM)
    inside = raw[tb.ALNUM[raw]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
    coded = text.dictionary_encode()
    grams, at = subwords(*utf8(coded.dictionary))
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    again = repeats(of, tb.row_of(rows))
    before = np.concatenate([[0], np.cumsum(~again)])
    return Words(grams, at, of[~again], before[rows])


def repeats(of: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mask of occurrences whose word also stands among the WINDOW - 1 words before it in its row."""
    order = np.lexsort((np.arange(len(of)), of, row))
    again = np.zeros(len(of), bool)
    a, b = order[:-1], order[1:]
    again[b] = (of[a] == of[b]) & (row[a] == row[b]) & (b - a < WINDOW)
    return again


def subwords(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's character n-grams and of the word itself, word by word, with bounds."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    at = bounds[:-1] + 2 * np.arange(n)  # each word with a mark before and after it
    marked = np.zeros(len(raw) + 2 * n, np.uint8)
    body = np.ones(len(marked), bool)
    body[at] = body[at + size + 1] = False
    marked[at] = 0x3C
    marked[at + size + 1] = 0x3E
    marked[body] = raw
    chars = np.frombuffer(marked.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(marked) + 1, np.int64)
    np.cumsum((marked & 0xC0) != 0x80, out=first[1:])
    edges = first[np.append(at, len(marked))]
    size = np.diff(edges)
    value = tb.mix(chars.astype(np.uint64) + np.uint64(1))
    word, bucket = [np.arange(n)], [np.zeros(n, np.uint64)]
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(tb.mix(value * (np.arange(len(chars)) - np.repeat(edges[:-1], size) + 1).astype(np.uint64)), out=total[1:])
    bucket[0] = tb.mix(total[edges[1:]] - total[edges[:-1]])
    for k in SIZES:
        m = max(0, len(chars) - k + 1)
        code = np.full(m, np.uint64(k))
        for j in range(k):
            code = tb.mix(code ^ value[j: j + m])
        bucket.append(code[tb.window_starts(edges, k)[:m]])
        word.append(np.repeat(np.arange(n), np.maximum(size - k + 1, 0)))
    word, bucket = np.concatenate(word), np.concatenate(bucket)
    order = np.argsort(word, kind="stable")
    return (bucket[order] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(word[order], np.arange(n + 1))


def windows(rows: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) over occurrences; every word of every row is in a window, the last one may be short."""
    n = np.diff(rows)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // step)), 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = rows[row] + step * nth
    return start, np.minimum(start + size, rows[row + 1]), row


@dataclass
class Model:
    buckets: np.ndarray  # float32, one toxic-minus-clean output a bucket
    bias: float
    scale: float  # Platt
    shift: float

    def logits(self, words: Words) -> np.ndarray:
        """Largest window logit of every row."""
        sums = np.concatenate([[0.0], np.cumsum(self.buckets[words.grams], dtype=np.float64)])
        size = np.diff(words.bounds)
        value = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(size, 1)
        run = np.concatenate([[0.0], np.cumsum(value[words.of])])
        start, end, row = windows(words.rows, WINDOW, STEP)
        mean = (run[end] - run[start]) / WINDOW
        best = np.full(len(words.rows) - 1, -np.inf)
        np.maximum.at(best, row, mean)
        return np.where(np.isfinite(best), best, 0.0) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(words_of(column)) + self.shift, -40, 40)))


class _Net:
    """Embedding rows and softmax of the training run."""

    def __init__(self, words: Words, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = words
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
        self.w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.seen_e, self.seen_w, self.seen_b = np.full(1 << BITS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def step(self, start: np.ndarray, end: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """One Adagrad step over a batch of windows; the softmax sees WINDOW times the mean, which only sets the step size."""
        size = end - start
        window = np.repeat(np.arange(len(size)), size)
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(window))
        used, inv = np.unique(self.words.of[place], return_inverse=True)
        n_grams = self.words.bounds[used + 1] - self.words.bounds[used]
        first = np.cumsum(n_grams) - n_grams
        flat = self.words.grams[np.repeat(self.words.bounds[used] - first, n_grams) + np.arange(n_grams.sum())]
        vec = np.add.reduceat(self.e[flat], first) / n_grams[:, None]
        total = np.add.reduceat(vec[inv], np.cumsum(size) - size)
        z = total @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - np.stack([1 - toxic, toxic], 1)) * weight[:, None]
        d_total = err @ self.w.T
        order = np.argsort(inv, kind="stable")
        d_vec = np.add.reduceat(d_total[window[order]], np.searchsorted(inv[order], np.arange(len(used)))) / n_grams[:, None]
        each = np.repeat(np.arange(len(used)), n_grams)
        d_e = np.stack([np.bincount(flat, d_vec[each, j], 1 << BITS) for j in range(DIM)], 1)
        self.seen_e += (d_e**2).mean(1)
        self.e -= RATE * d_e / np.sqrt(self.seen_e)[:, None]
        for now, grad, seen in ((self.w, total.T @ err, self.seen_w), (self.b, err.sum(0), self.seen_b)):
            seen += grad**2
            now -= (0.1 * RATE * grad / np.sqrt(seen)).astype(np.float32)

    def model(self) -> Model:
        """Toxic-minus-clean output of each bucket's vector, with the factor of ``step``."""
        return Model((WINDOW * (self.e @ (self.w[:, 1] - self.w[:, 0]))).astype(np.float32), float(self.b[1] - self.b[0]), 1.0, 0.0)


def _windows_logit(model: Model, words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(model.buckets[words.grams], dtype=np.float64)])
    value = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(np.diff(words.bounds), 1)
    run = np.concatenate([[0.0], np.cumsum(value[words.of])])
    return (run[end] - run[start]) / WINDOW + model.bias


def fit(texts: list[str], toxic: np.ndarray, epochs: tuple[int, int] = EPOCHS) -> Model | None:
    """Train on four rows of five, calibrate on the fifth; None unless both classes occur in the former."""
    words = words_of(pa.array(texts, pa.large_string()))
    held = np.arange(len(texts)) % 5 == 4
    start, end, row = windows(words.rows, WINDOW, WINDOW)
    use = ~held[row]
    start, end, row = start[use], end[use], row[use]
    y = toxic[row].astype(np.float32)
    if not 0 < y.mean() < 1 if len(y) else True:
        return None
    net, rng = _Net(words), np.random.default_rng(12)
    keep = np.arange(len(row))
    for part, rounds in enumerate(epochs):
        for _ in range(rounds):
            if part:  # toxic windows are those found toxic, and the best one of each toxic text
                logit = _windows_logit(net.model(), words, start, end)
                best = np.full(len(texts), -np.inf)
                np.maximum.at(best, row, logit)
                keep = np.flatnonzero((y == 0) | (logit > 0) | (logit == best[row]))
            share = y[keep].mean()
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            order = rng.permutation(keep)
            for k in range(0, len(order), BATCH):
                b = order[k: k + BATCH]
                net.step(start[b], end[b], y[b], weight[b] / len(b))
    model = net.model()
    z = model.logits(words)
    pick = held if len(set(toxic[held].tolist())) == 2 else ~held
    model.scale, model.shift = _platt(z[pick], toxic[pick])
    return model


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_rows: int = TRAIN_ROWS, epochs: tuple[int, int] = EPOCHS) -> Model | None:
    """Fit on the ``train_rows`` labelled ids of each class with the smallest hashes that have a text and are not held out."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold() != 0))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null"), "doc_id", "left_semi")
    picked = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        picked = one if picked is None else picked.unionAll(one)
    rows = (id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")  # at most 2 x train_rows rows
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))

    def one_fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        model = fit(frame["text"].tolist(), frame["toxic"].to_numpy(), epochs)
        found = [] if model is None else [model]
        return pd.DataFrame({"buckets": [m.buckets.tobytes() for m in found], "bias": [m.bias for m in found],
                             "scale": [m.scale for m in found], "shift": [m.shift for m in found]})

    found = rows.withColumn("whole", F.lit("all")).groupBy("whole").applyInPandas(one_fit, "buckets binary, bias double, scale double, shift double").collect()
    return Model(np.frombuffer(bytes(found[0]["buckets"]), np.float32), *found[0][1:]) if found else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Fold, score and verdict of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(1)) if model else np.full(batch.num_rows, UNKNOWN)
            cols = [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).withColumn("held_out", fold() == 0).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    prepare(docs.sparkSession)
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    return score(docs, train(docs, labels, **options), **names)
