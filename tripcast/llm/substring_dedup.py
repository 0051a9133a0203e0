"""Operator 4, substring dedup: words covered by a 50-word window that also starts in an earlier document.

1. Count-min prefilter. Every window is put under an anchor, a stretch of
   ``GRAM`` words that equal windows share (``blocks.Anchors``), so a window
   occurs no more often than its anchor. Each chunk's sketch of its anchors
   travels by blocks of the hash space, as the list of cells it touches; a block
   adds the sketches up to counters of ``DEPTH`` rows and estimates every anchor
   by its smallest counter. Estimates never fall short, so no window is lost.
2. Exact second pass. Only windows whose anchor is estimated to occur in two or
   more texts are grouped, by 128 bits of their words, with the smallest id they
   start in.
3. Removal. Windows whose smallest id is below the document's own are marked, and
   every word they cover is removed.

Scale: texts are shuffled once (the exchange is reused by all steps), then 4
bytes for each distinct anchor of a chunk, then 24 bytes for each window that is
estimated repeated, once for each chunk. The sketch grows with the text in
blocks of fixed load, so its precision is the same at every size, and it is never
broadcast.

Defined cases: null text has no words; rows without an id are kept whole and
remove nothing; texts under one id do not remove each other; texts under 50
words stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textbytes as tb

SIZE = 50
GRAM = 16  # words of an anchor
DEPTH = 3  # rows of a sketch
LOAD = 4  # counters of a row for each cell list entry of a block
BLOCK_TEXT = 16 << 20  # anchors are few: a block stands for so much text
_ROWS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


class Words:
    """Words of a chunk, their hashes and the windows' 128 bits."""

    def __init__(self, chunk: bl.Chunk):
        self.starts, self.ends, self.bounds = tb.word_spans(chunk.raw, chunk.bounds, tb.NOT_SPACE)
        hashes = tb.Prefix(chunk.raw).stretches(self.starts, self.ends)
        self.first = tb.Prefix(hashes)
        # a second hash of each word, from the bytes again, so that equal words under one hash differ under the other
        self.second = tb.Prefix(tb.Prefix(chunk.raw, 1).stretches(self.starts, self.ends), 1)

    def window_codes(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.first.stretches(at, at + size), self.second.stretches(at, at + size)


def sketch_estimates(cells: list[np.ndarray], depth: int = DEPTH, load: int = LOAD) -> list[np.ndarray]:
    """Merge the sketches of several chunks (each a list of cell codes) and estimate every code's count."""
    every = np.concatenate(cells)
    bits = max(8, int(load * max(1, len(every)) - 1).bit_length())
    least = None
    for r in range(depth):
        at = _cell(every, r, bits)
        found = np.bincount(at, minlength=1 << bits)[at]
        least = found if least is None else np.minimum(least, found)
    return np.split(least, np.cumsum([len(c) for c in cells])[:-1])


def _cell(codes: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = codes.astype(np.uint64) * (_ROWS[row] | (_ROWS[row] << np.uint64(32)) | np.uint64(1))
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


RESULT = "sha string, rep_id long, n_words long, n_removed long, kept_sha256 string, kept string, base_sha256 string"


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM,
                  with_text: bool = True) -> DataFrame:
    """Per row: n_words, n_removed, kept_sha256 and, with ``with_text``, the kept words."""
    base, texts, total = bl.chunked(docs, id_col, text_col)
    blocks = bl.n_blocks(total, BLOCK_TEXT)
    window_blocks = bl.n_blocks(total)

    def anchors(chunk: bl.Chunk) -> tuple[Words, bl.Anchors]:
        words = Words(chunk)
        return words, bl.Anchors(words.first, words.bounds, size, gram)

    def send_sketch(table: pa.Table) -> pa.Table:
        chunk = bl.Chunk(table)
        return bl.hash_rows(np.unique(bl.block_key(anchors(chunk)[1].hashes, blocks)), chunk.number)

    def estimate(table: pa.Table) -> pa.Table:
        found = sketch_estimates([np.frombuffer(b, np.uint32) for b in table["blob"].to_pylist()])
        blobs = [np.packbits(f >= 2).tobytes() for f in found]
        return pa.table({"block": table["block"], "chunk": table["chunk"], "blob": pa.array(blobs, pa.binary())})

    def distinct_windows(chunk: bl.Chunk, words: Words, a: bl.Anchors, pick: np.ndarray):
        """(first word, row, codes, distinct number) of the windows under the picked anchors, and of each distinct one its
        two codes and smallest id."""
        n = a.windows[pick]
        at = np.repeat(a.first[pick], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        row = np.repeat(a.row[pick], n)
        one, two = words.window_codes(at, size)
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(at) else np.zeros(0, bool)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, which, chunk.ids[row] if len(at) else np.zeros(0, np.int64))
        return at, row, which, one[order][new], two[order][new], least

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return bl.rows([], -1, [])
        chunk = bl.Chunk(left)
        words, a = anchors(chunk)
        keys, which = np.unique(bl.block_key(a.hashes, blocks), return_inverse=True)
        repeated = bl.answers(keys, right, bits=True).astype(bool)
        *_, one, two, least = distinct_windows(chunk, words, a, np.flatnonzero(repeated[which]))
        block, at = bl.by_block(bl.block_key(one, window_blocks))  # codes are sorted, so blocks are too
        return bl.rows(block.tolist(), chunk.number, [bl.pack(one[x:y], two[x:y], least[x:y]) for x, y in zip(at, at[1:])])

    def group_windows(table: pa.Table) -> pa.Table:
        parts = [bl.unpack(b, np.uint64, np.uint64, np.int64) for b in table["blob"].to_pylist()]
        one, two, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][new][np.cumsum(new) - 1]
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        numbers, out_chunk, out = table["chunk"].to_pylist(), [], []
        gone = least < ids  # only windows that start under a smaller id somewhere go back
        for i in np.unique(source[gone]).tolist():
            mine = gone & (source == i)
            out_chunk.append(numbers[i])
            out.append(bl.pack(one[mine], two[mine]))
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "blob": pa.array(out, pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: dict[str, list] = {f.split()[0]: [] for f in RESULT.split(", ")}
        if len(left):
            chunk = bl.Chunk(left)
            words, a = anchors(chunk)
            at, row, which, one, two, least = distinct_windows(chunk, words, a, np.arange(len(a.first)))
            earlier = np.zeros(len(one), bool)
            for blob in right["blob"].to_pylist():
                x, y = bl.unpack(blob, np.uint64, np.uint64)
                lo = np.searchsorted(one, x)
                while len(lo):  # distinct windows under one first code stand together
                    hit = (lo < len(one)) & (one[np.minimum(lo, len(one) - 1)] == x)
                    lo, x, y = lo[hit], x[hit], y[hit]
                    same = two[lo] == y
                    earlier[lo[same]] = True
                    lo, x, y = lo[~same] + 1, x[~same], y[~same]
            own = chunk.ids[row] if len(at) else np.zeros(0, np.int64)
            marked = earlier[which] | (own > least[which])  # or an earlier document of this chunk has it
            n = len(words.starts)
            gone = tb.covered(at[marked], size, n) if n else np.zeros(0, bool)
            removed = tb.per_row(gone, words.bounds)
            for i, (sha, doc_id, k) in enumerate(zip(chunk.sha, chunk.ids.tolist(), removed.tolist())):
                x, y = int(words.bounds[i]), int(words.bounds[i + 1])
                every = chunk.raw[chunk.bounds[i]: chunk.bounds[i + 1]].tobytes().split()
                kept = b" ".join(every)
                columns["base_sha256"].append(hashlib.sha256(kept).hexdigest())
                if k:
                    kept = b" ".join([w for w, g in zip(every, gone[x:y].tolist()) if not g])
                columns["sha"].append(sha), columns["rep_id"].append(doc_id), columns["n_words"].append(y - x)
                columns["n_removed"].append(k)
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest() if k else columns["base_sha256"][-1])
                columns["kept"].append(kept.decode("utf-8", "replace") if with_text else None)
        kinds = dict(zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    by_chunk = texts.groupBy("chunk")
    repeated = by_chunk.applyInArrow(send_sketch, bl.ROW).groupBy("block").applyInArrow(estimate, bl.ROW)
    windows = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(send_windows, bl.ROW)
    marks = windows.groupBy("block").applyInArrow(group_windows, "chunk long, blob binary")
    done = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(remove, RESULT)

    own = F.col("doc_id") == F.col("rep_id")
    copy = (F.col("doc_id") > F.col("rep_id")) & (F.col("n_words") >= size)  # a later copy of a text
    out = ["doc_id", "n_words",
           F.when(own, F.col("n_removed")).when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
           F.when(own, F.col("kept_sha256")).when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("base_sha256")).alias("kept_sha256")]
    if with_text:
        out.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))  # a copy under 50 words loses nothing
    with_id = base.where("doc_id is not null").select("doc_id", "sha").join(done, "sha").select(*out)
    without = base.where("doc_id is null").select("doc_id", "text").mapInArrow(_whole, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return with_id.unionByName(without.select(*with_id.columns))


def _whole(batches):
    """Rows without an id: all words stay."""
    for batch in batches:
        words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
        kept = [b" ".join(w) for w in words]
        n = len(kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * n, pa.int64()), pa.array(list(map(len, words)), pa.int64()), pa.array([0] * n, pa.int64()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
