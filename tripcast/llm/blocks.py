"""Texts in chunks and hashes in blocks: the shuffles behind the repeat finders.

``chunked`` deals the distinct texts to chunks of about ``CHUNK_BYTES`` by the
text's digest, so copies (however many) weigh once and no source or id is hot.
A job's steps meet a chunk's texts again and again through the same exchange,
which Spark writes once and reuses.

``to_blocks`` cuts the sorted distinct hashes of a chunk into rows, one for each
block of the hash space. Only the low 32 bits travel; the answer for a block
comes back in the same order, so neither ids nor positions travel with it. A
hash counts once for each chunk, however often the chunk holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import empty_safe_size, id_and_text, prepare, utf8

CHUNK_BYTES = 3 << 19  # text of a chunk: what one call of a group function holds
CHUNKS_PER_PARTITION = 16
BLOCK_TEXT = 8 << 20  # text behind a block of hashes
LEAST = 8


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_bytes, text): the digest stands for the whole text."""
    base = id_and_text(docs, id_col, text_col)
    return base.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), "text")


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side part of min(doc_id) by text: of a partition's copies only those with a smaller id than all before leave it."""
    best: dict[str, int] = {}
    for batch in batches:
        keep = []
        for i, (doc_id, sha) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if doc_id is not None and doc_id < best.get(sha, 1 << 63):
                best[sha] = doc_id
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(rows with digests, distinct texts by chunk, bytes of all texts). Rows without an id have no chunk."""
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed(docs, id_col, text_col)
    total = empty_safe_size(rows, F.col("n_bytes"))
    n = max(LEAST, -(-total // CHUNK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // CHUNKS_PER_PARTITION))
    texts = (rows.select("doc_id", "sha", "text").mapInArrow(_first_copies, "doc_id long, sha string, text string")
             .withColumn("chunk", F.pmod(F.xxhash64("sha"), F.lit(n))).repartition(parts, "chunk"))
    return rows, texts, total


class Chunk:
    """The distinct texts of a chunk in the order of their digests, each under its smallest id."""

    def __init__(self, table: pa.Table):
        best: dict[str, tuple[int, int]] = {}
        for i, (doc_id, sha) in enumerate(zip(table["doc_id"].to_pylist(), table["sha"].to_pylist())):
            if sha not in best or doc_id < best[sha][0]:
                best[sha] = (doc_id, i)
        self.number = table["chunk"][0].as_py() if len(table) else -1
        self.sha = sorted(best)
        self.ids = np.array([best[s][0] for s in self.sha], np.int64)
        column = table["text"].take(pa.array([best[s][1] for s in self.sha], pa.int64()))
        self.raw, self.bounds = utf8(column)


def n_blocks(total_bytes: int, text: int = BLOCK_TEXT) -> int:
    return max(LEAST, -(-total_bytes // text))


def block_key(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """block << 32 | low bits; blocks are equal ranges of the high bits."""
    high = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    return (high << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, behind their lengths; types are agreed on by the reader."""
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, np.int64, len(types))
    at, out = 8 * len(types), []
    for n, kind in zip(lengths.tolist(), types):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def by_block(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks present, bounds) of sorted block keys."""
    block = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return block[first], np.append(first, len(block))


ROW = "block long, chunk long, blob binary"


def rows(block: list[int], chunk: int, blobs: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "chunk": pa.array([chunk] * len(block), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def hash_rows(keys: np.ndarray, chunk: int) -> pa.Table:
    """One row per block of a chunk's sorted distinct block keys."""
    block, at = by_block(keys)
    low = keys.astype(np.uint32)
    return rows(block.tolist(), chunk, [low[a:b].tobytes() for a, b in zip(at, at[1:])])


def answers(keys: np.ndarray, table: pa.Table, kind=np.uint8, bits: bool = False) -> np.ndarray:
    """The answer for every key of a chunk, from the rows (block, blob) that came back."""
    block, at = by_block(keys)
    place = {b: (x, y) for b, x, y in zip(block.tolist(), at[:-1].tolist(), at[1:].tolist())}
    out = np.zeros(len(keys), kind)
    for b, blob in zip(table["block"].to_pylist(), table["blob"].to_pylist()):
        x, y = place[b]
        got = np.frombuffer(blob, kind)
        out[x:y] = np.unpackbits(got, count=y - x) if bits else got
    return out


class Anchors:
    """Window sampling that loses nothing: every window of ``size`` elements is put under the smallest hash of its
    ``size - k + 1`` stretches of k elements, so equal windows are put under equal anchors."""

    def __init__(self, prefix: tb.Prefix, bounds: np.ndarray, size: int, k: int):
        reach = size - k + 1
        assert reach <= 64
        grams = prefix.windows(k)
        n = len(grams)
        zero = np.zeros(0, np.int64)
        self.first = self.windows = self.row = zero
        self.hashes = np.zeros(0, np.uint64)
        if n < reach:
            return
        least = (grams & ~np.uint64(63)) | (np.arange(n, dtype=np.uint64) & np.uint64(63))
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span:])
        start = np.flatnonzero(tb.window_starts(bounds, size)[: len(least)])
        if len(start) == 0:
            return
        at = start + (((least[start] & np.uint64(63)).astype(np.int64) - start) & 63)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        self.first = start[new]  # first window under the anchor
        self.windows = np.diff(np.append(new, len(start)))  # and how many follow one another
        self.hashes = tb.mix(grams[at[new]] ^ np.uint64(0x5851F42D4C957F2D))
        self.row = np.searchsorted(bounds, self.first, "right") - 1


def several_docs(groups: np.ndarray, rows_: np.ndarray, n: int) -> np.ndarray:
    """Mask over n groups: their elements come from two or more rows."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, groups, rows_)
    np.maximum.at(high, groups, rows_)
    return high > low
