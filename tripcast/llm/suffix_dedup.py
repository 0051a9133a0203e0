"""Operator 2, suffix-array dedup: bytes covered by a long string that also starts in an earlier document.

1. Candidates. Every 50-byte string is put under an anchor (``blocks.Anchors``),
   so equal strings are under equal anchors. Anchors that only one text holds
   cannot repeat; the rest are found by counting anchor hashes in blocks.
2. Shards. The stretches under the remaining anchors are dealt to shards by
   anchor hash, each distinct stretch of a chunk once, under its smallest id.
   A shard's distinct stretches are one string; its suffix array comes from
   induced sorting, its common prefixes from the permuted form
   (``suffix_array``). Suffixes whose neighbours share 50 bytes or more form a
   group: one repeated string, with the smallest id it starts in.
3. Removal. Strings whose smallest id is below the document's own are marked,
   and every byte they cover is removed.

Scale: texts are shuffled once (the exchange is reused by all steps), then 4
bytes for each distinct anchor of a chunk, then the repeated stretches. Copies of
a text are one text. A string that stands in many documents weighs once for each
chunk, and long shards are sorted in pieces of ``SHARD_BYTES`` between anchors.
There is no broadcast.

Defined cases: null text is empty; rows without an id are kept whole and remove
nothing; rows of one id and text get equal results, texts under one id do not
remove each other; texts under 50 bytes stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textbytes as tb
from .suffix_array import induced_order, permuted_common_prefixes

SIZE = 50
GRAM = 24  # bytes of an anchor
SHARD_BYTES = 2 << 20
_BREAK = 0xFF  # no byte of UTF-8 text


class Stretches:
    """The distinct stretches of a chunk: all windows under one anchor, as one piece of text."""

    def __init__(self, chunk: bl.Chunk, size: int, gram: int):
        prefix = tb.Prefix(chunk.raw)
        a = bl.Anchors(prefix, chunk.bounds, size, gram)
        self.anchors = a
        self.end = a.first + a.windows + size - 1
        code = prefix.stretches(a.first, self.end) ^ a.windows.astype(np.uint64)
        self.codes, first, self.which = np.unique(code, return_index=True, return_inverse=True)
        ids = chunk.ids[a.row] if len(a.row) else np.zeros(0, np.int64)
        self.smallest = np.full(len(self.codes), np.iinfo(np.int64).max)
        np.minimum.at(self.smallest, self.which, ids)
        self.ids, self.sample = ids, first


def repeated_windows(texts: list[bytes], ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch, as bits (first window lowest): its windows that also start under a smaller id in another stretch, and
    all its windows. One shard, one suffix array."""
    lengths = np.array([len(t) for t in texts])
    s = np.frombuffer(bytes([_BREAK]).join(texts) + bytes([_BREAK]), np.uint8)
    stop = np.cumsum(lengths + 1) - 1  # where each stretch ends
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    sa = induced_order(s, 256)
    shared = permuted_common_prefixes(s, sa, stop[owner])
    group = np.cumsum(shared[sa] < size)
    own = owner[sa]
    ok = stop[own] - sa >= size  # a whole window starts here
    place, own, group = sa[ok], own[ok], group[ok]
    least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[own])
    marked = least[group] < ids[own]
    offset = place[marked] - (stop - lengths)[own[marked]]
    bits = np.bincount(own[marked], np.exp2(offset), len(texts)).astype(np.uint64)  # fewer than 53 windows: exact
    return bits, (np.uint64(1) << (lengths - size + 1).astype(np.uint64)) - np.uint64(1)


RESULT = "sha string, rep_id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM,
                     with_text: bool = True) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the removed byte spans and the kept bytes."""
    base, texts, total = bl.chunked(docs, id_col, text_col)
    blocks = bl.n_blocks(total)

    def send_hashes(table: pa.Table) -> pa.Table:
        chunk = bl.Chunk(table)
        a = bl.Anchors(tb.Prefix(chunk.raw), chunk.bounds, size, gram)
        return bl.hash_rows(np.unique(bl.block_key(a.hashes, blocks)), chunk.number)

    def find_repeated(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(b, np.uint32) for b in table["blob"].to_pylist()]
        every = np.sort(np.concatenate(lows))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = [np.packbits(np.isin(low, twice, assume_unique=True)).tobytes() for low in lows]
        return pa.table({"block": table["block"], "chunk": table["chunk"], "blob": pa.array(out, pa.binary())})

    def send_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return bl.rows([], -1, [])
        chunk = bl.Chunk(left)
        s = Stretches(chunk, size, gram)
        keys, which = np.unique(bl.block_key(s.anchors.hashes, blocks), return_inverse=True)
        repeated = bl.answers(keys, right, bits=True).astype(bool) | bl.several_docs(which, s.anchors.row, len(keys))
        pick = np.flatnonzero(repeated[which[s.sample]])  # distinct stretches under repeated anchors
        anchor = s.sample[pick]
        shard = (keys[which[anchor]] >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((s.codes[pick], s.anchors.hashes[anchor], shard))
        pick, anchor, shard = pick[order], anchor[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        blobs = []
        for x, y in zip(first, np.append(first[1:], len(shard))):
            a = anchor[x:y]
            start, end = s.anchors.first[a], s.end[a]
            body = np.concatenate([chunk.raw[i:j] for i, j in zip(start.tolist(), end.tolist())])
            blobs.append(bl.pack(s.anchors.hashes[a], s.codes[pick[x:y]], s.smallest[pick[x:y]], (end - start).astype(np.uint16), body))
        return bl.rows(shard[first].tolist(), chunk.number, blobs)

    def sort_shard(table: pa.Table) -> pa.Table:
        hashes, codes, ids, source, bodies = [], [], [], [], []
        for i, blob in enumerate(table["blob"].to_pylist()):
            h, c, d, n, body = bl.unpack(blob, np.uint64, np.uint64, np.int64, np.uint16, np.uint8)
            body, at = body.tobytes(), np.concatenate([[0], np.cumsum(n.astype(np.int64))]).tolist()
            hashes.append(h), codes.append(c), ids.append(d), source.append(np.full(len(h), i))
            bodies += [body[a:b] for a, b in zip(at, at[1:])]
        hashes, codes, ids, source = map(np.concatenate, (hashes, codes, ids, source))
        found: dict[int, list[tuple[int, int]]] = {}
        order = np.argsort(hashes, kind="stable").tolist()
        a = 0
        while a < len(order):  # a piece of the shard: whole anchors, up to SHARD_BYTES of distinct text
            distinct: dict[bytes, int] = {}
            members, weight, b = [], 0, a
            while b < len(order) and (weight < SHARD_BYTES or hashes[order[b]] == hashes[order[b - 1]]):
                body = bodies[order[b]]
                if body not in distinct:
                    weight += len(body)
                members.append(distinct.setdefault(body, len(distinct)))
                b += 1
            part = np.array(order[a:b])
            members = np.array(members)
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, members, ids[part])
            bits, whole = repeated_windows(list(distinct), least, size)
            # a stretch that a smaller id holds as it stands is removed whole
            mask = np.where(ids[part] > least[members], whole[members], bits[members])
            for i in np.flatnonzero(mask).tolist():
                found.setdefault(int(source[part[i]]), []).append((int(codes[part[i]]), int(mask[i])))
            a = b
        number = table["chunk"].to_pylist()
        pairs = sorted(found.items())
        return pa.table({"chunk": pa.array([number[i] for i, _ in pairs], pa.int64()),
                         "blob": pa.array([np.array(p, np.uint64).tobytes() for _, p in pairs], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: dict[str, list] = {k: [] for k in ("sha", "rep_id", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        if len(left):
            chunk = bl.Chunk(left)
            s = Stretches(chunk, size, gram)
            a = s.anchors
            mask = np.zeros(len(s.codes), np.uint64)
            got = [np.frombuffer(b, np.uint64).reshape(-1, 2) for b in right["blob"].to_pylist()]
            if got:
                got = np.concatenate(got)
                mask[np.searchsorted(s.codes, got[:, 0])] = got[:, 1]
            # a copy of a stretch under a larger id of this chunk is removed whole
            whole = (np.uint64(1) << a.windows.astype(np.uint64)) - np.uint64(1)
            every = np.where(s.ids > s.smallest[s.which], whole, mask[s.which]) if len(a.row) else np.zeros(0, np.uint64)
            hit = np.flatnonzero(every)
            starts = [a.first[hit[on]] + w for w in range(size - gram + 1)
                      if len(on := np.flatnonzero((every[hit] >> np.uint64(w)) & np.uint64(1)))]
            gone = tb.covered(np.concatenate(starts), size, len(chunk.raw)) if starts else np.zeros(len(chunk.raw), bool)
            removed = tb.per_row(gone, chunk.bounds)
            for i, (sha, doc_id, n) in enumerate(zip(chunk.sha, chunk.ids.tolist(), removed.tolist())):
                x, y = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
                spans, kept = [], None
                if n:
                    step = np.diff(np.concatenate([[0], gone[x:y].view(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
                    kept = chunk.raw[x:y][~gone[x:y]].tobytes()
                columns["sha"].append(sha), columns["rep_id"].append(doc_id), columns["n_removed"].append(n)
                columns["n_spans"].append(len(spans))
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest() if n else sha)
                columns["spans"].append([{"start": p, "end": q} for p, q in spans] if with_text else [])
                columns["kept"].append((kept if n else chunk.raw[x:y].tobytes()) if with_text else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = dict(zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    by_chunk = texts.groupBy("chunk")
    sent = by_chunk.applyInArrow(send_hashes, bl.ROW)
    repeated = sent.groupBy("block").applyInArrow(find_repeated, bl.ROW)
    stretches = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(send_stretches, bl.ROW)
    marks = stretches.groupBy("block").applyInArrow(sort_shard, "chunk long, blob binary")
    done = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(remove, RESULT)

    own = F.col("doc_id") == F.col("rep_id")
    copy = (F.col("doc_id") > F.col("rep_id")) & (F.col("n_bytes") >= size)  # a later copy of a text

    def pick(mine, of_copy, plain):
        return F.when(own, mine).when(copy, of_copy).otherwise(plain)

    out = ["doc_id", "n_bytes",
           pick(F.col("n_removed"), F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"),
           pick(F.col("n_spans"), F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
           pick(F.col("kept_sha256"), F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha")).alias("kept_sha256")]
    rows = base.select("doc_id", "sha", "n_bytes", *(["text"] if with_text else []))
    if with_text:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        out += [pick(F.col("spans"), whole, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
                pick(F.col("kept"), F.lit(b""), F.col("text").cast("binary")).alias("kept")]
    return rows.join(done, "sha", "left").select(*out)
