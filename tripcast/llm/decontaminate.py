"""Operator 8, benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are compared with ASCII and Latin-1 capitals lower-cased and white space as single spaces. A
document leaks an item if some stretch of it is within ``max_edits(item)``
character edits: a tenth of the item's length (and less for items so short that
a piece would fall under eight characters).

1. Windows. An item is cut into m pieces of eight or more characters. k edits
   leave m - k of them intact, and shift them against each other by at most k. So
   item-sized windows start where at least m - k piece beginnings (eight bytes)
   lie on alignments within k of each other, one window for each alignment. No
   stretch within the bound is lost here.
2. CGK. A window and the items walk through the same random functions: at step j
   the symbol under the pointer is written and the pointer moves on or stays as
   function j tells for that symbol. Few edits give a small Hamming distance.
3. LSH. A repetition samples coordinates of a walk; windows and items with equal
   samples are candidates. ``WALKS * SAMPLES`` repetitions reach the target recall
   (``tests/llm`` measure it against brute force).
4. Verification. Bit-parallel approximate matching gives the exact smallest edit
   distance of the item to a stretch around the window.

Scale: documents are scanned by maps without a shuffle, bounded by an Arrow
batch. The items are a query set: they go to the tasks in blocks of at most
``ITEM_BYTES`` of text, one scan for each block, so what a task holds is bounded
whatever the benchmark's size.

Defined cases: null texts are empty and match nothing; empty items match nothing;
items under eight bytes match exactly; repeated rows give equal rows; equal items
are reported under each of their ids; an empty table gives no rows; other columns
are ignored (and kept by ``remove_leaks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import id_and_text, prepare, utf8

MAX_EDIT_SHARE = 0.1
PIECE = 8  # bytes of a piece that must be intact
WALKS = 4  # independent random walks
SAMPLES = 24  # repetitions of bit sampling on each walk
COORDINATES = 5  # sampled symbols of a repetition
ITEM_BYTES = 4 << 20
SLICE = 8_192  # windows embedded at a time
SCAN_BYTES = 1 << 19  # text whose pieces are looked up at once (one document may exceed it alone)
GATHER_BYTES = 1 << 18  # text of windows cut out at once
SEED = 11
SCHEMA = "doc_id long, item_id long, edits long, max_edits long, start long, end long"

_SPACE = ~tb.NOT_SPACE


def normalise(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, place of every kept byte in the input): small letters (ASCII and Latin-1), runs of white space as one space."""
    if len(raw) == 0:
        return raw, bounds, np.zeros(0, np.int64)
    space = _SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = bounds[:-1][bounds[:-1] < len(raw)]
    keep[first] = True
    out = tb.LOWER[raw]
    out[space] = 0x20
    # capital letters of Latin-1 (all but the multiplication sign) are C3 80 .. C3 9E, small ones 32 higher
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][capital] += 32
    at = np.flatnonzero(keep).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
    return out[keep], np.searchsorted(at, bounds), at


def plain(text: str | None) -> bytes:
    """The normal form of one item, without white space at its ends."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def max_edits(n: int, share: float = MAX_EDIT_SHARE) -> int:
    """Edits allowed for an item of n characters: pieces keep eight characters."""
    return max(0, min(int(share * n), n // PIECE - 1))


def edit_search(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``text`` nearest to ``pattern`` (the first one), if within ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        diag = ((((eq & up) + up) ^ up) | eq) & full
        plus = (down | ~(diag | up)) & full
        minus = up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = (minus | ~(x | plus)) & full
        down = plus & x
        if score <= most and (best is None or score < best[0]):
            best = (score, j)
    return best


def char_starts(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    return np.flatnonzero((raw & 0xC0) != 0x80)


class Items:
    """Pieces, walks and LSH tables of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], share: float = MAX_EDIT_SHARE):
        texts: dict[bytes, list[int]] = {}
        for item_id, text in rows:
            norm = plain(text)
            if norm:
                texts.setdefault(norm, []).append(item_id)
        self.texts = list(texts)
        self.ids = [sorted(texts[t]) for t in self.texts]
        self.chars = [t.decode("utf-8", "replace") for t in self.texts]
        self.edits = [max_edits(len(c), share) for c in self.chars]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.short = [i for i, t in enumerate(self.texts) if len(t) < PIECE]
        codes, owner, offset, char_offset, need = [], [], [], [], []
        for i, t in enumerate(self.texts):
            if len(t) < PIECE:
                need.append(1)
                continue
            starts = char_starts(t)
            m = max(1, len(starts) // PIECE)
            need.append(m - self.edits[i])
            for p in range(m):
                at = int(starts[p * len(starts) // m])
                codes.append(int.from_bytes(t[at: at + PIECE], "little"))
                owner.append(i)
                offset.append(at)
                char_offset.append(p * len(starts) // m)
        order = np.argsort(np.array(codes, np.uint64), kind="stable")
        self.codes = np.array(codes, np.uint64)[order]
        self.owner, self.offset = np.array(owner, np.int64)[order], np.array(offset, np.int64)[order]
        self.char_offset = np.array(char_offset, np.int64)[order]
        self.need, self.most = np.array(need, np.int64), np.array(self.edits, np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._cell(self.codes)] = True
        self.longest = int(self.size.max(initial=0))
        rng = np.random.default_rng(SEED)
        steps = 2 * self.longest + 1
        self.moves = rng.integers(0, 2, (WALKS, steps, 256), dtype=np.uint8)
        # coordinates are shares of an item's walk, so items of any length have theirs
        self.points = rng.random((WALKS, SAMPLES, COORDINATES))
        self.salt = rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
        raw = np.concatenate([np.frombuffer(t, np.uint8) for t in self.texts]) if self.texts else np.zeros(0, np.uint8)
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if self.texts else np.zeros(0, np.int64)
        self.keys = self.signatures(raw, starts, np.arange(len(self.texts)))
        self.sorted = [(np.argsort(k), np.sort(k)) for k in self.keys.T] if self.texts else []

    @staticmethod
    def _cell(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def signatures(self, raw: np.ndarray, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """LSH keys (windows x repetitions) of windows of the given items' sizes; symbols beyond ``raw`` are 0."""
        n = len(starts)
        out = np.zeros((n, WALKS * SAMPLES), np.uint64)
        if n == 0:
            return out
        size = self.size[items]
        length = 2 * size  # steps of a window's walk: on average the pointer reaches the end
        padded = np.concatenate([raw, np.zeros(1, np.uint8)])
        for w in range(WALKS):
            walk = np.zeros((int(length.max()), n), np.uint8)
            pointer = np.zeros(n, np.int64)
            for j in range(len(walk)):
                at = starts + pointer
                symbol = np.where(pointer < size, padded[np.clip(at, 0, len(raw))], 0)
                symbol[at < 0] = 0
                walk[j] = symbol
                pointer += self.moves[w, j][symbol]
            for s in range(SAMPLES):
                key = size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(w * SAMPLES + s)
                for c in range(COORDINATES):
                    pos = (self.points[w, s, c] * length).astype(np.int64)
                    key = tb.mix(key ^ (walk[pos, np.arange(n)].astype(np.uint64) * self.salt[c]))
                out[:, w * SAMPLES + s] = key
        return out

    def windows(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start byte, item) of the windows around intact pieces, each once. Rows are taken ``SCAN_BYTES`` at a time."""
        found, a = [(np.zeros(0, np.int64),) * 3], 0
        while a < len(bounds) - 1:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SCAN_BYTES, "right")) - 1)
            row, start, item = self._windows(raw[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
            found.append((row + a, start + bounds[a], item))
            a = b
        return tuple(map(np.concatenate, zip(*found)))

    def _windows(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hits = []
        for shift in range(PIECE):
            m = (len(raw) - shift) // PIECE
            if m <= 0 or len(self.codes) == 0:
                continue
            code = raw[shift: shift + m * PIECE].view("<u8")
            pos = np.flatnonzero(self.filter[self._cell(code)])
            code = code[pos]
            lo, hi = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, "right")
            n = hi - lo
            pos, lo, n = pos[n > 0] * PIECE + shift, lo[n > 0], n[n > 0]
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pos = np.repeat(pos, n)
            row = np.searchsorted(bounds, pos, "right") - 1
            inside = pos + PIECE <= bounds[row + 1]
            hits.append(np.stack([row, pos, which], 1)[inside])
        if not hits or not sum(map(len, hits)):
            zero = np.zeros(0, np.int64)
            return zero, zero, zero
        row, pos, which = np.concatenate(hits).T
        item, start = self.owner[which], pos - self.offset[which]
        # hits of a row and item side by side, in the order of their alignments (in characters)
        char = np.cumsum((raw & 0xC0) != 0x80)
        align = char[pos] - self.char_offset[which] + self.longest
        key = (row * len(self.texts) + item) * np.int64(len(raw) + 3 * self.longest + 8) + align
        order = np.lexsort((start, key))
        key, row, start, item = key[order], row[order], start[order], item[order]
        reach = np.searchsorted(key, key + self.most[item], "right")
        enough = reach - np.arange(len(key)) >= self.need[item]
        change = np.zeros(len(key) + 1, np.int64)
        np.add.at(change, np.flatnonzero(enough), 1)
        np.add.at(change, reach[enough], -1)
        keep = np.cumsum(change)[:-1] > 0
        keep[1:] &= (key[1:] != key[:-1]) | ~keep[:-1]
        return row[keep], start[keep], item[keep]

    def leaks(self, raw: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item number) -> (edits, first byte, end byte) of the nearest stretch, in normal bytes."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        row, start, item = self.windows(raw, bounds)
        order = np.argsort(self.size[item], kind="stable")  # windows of a slice are of like length
        for a in range(0, len(order), SLICE):
            part = order[a: a + SLICE]
            # a window never sees its neighbour's text
            keys = self._row_signatures(raw, bounds, row[part], start[part], item[part])
            seen = set()
            for r, (ids, values) in enumerate(self.sorted):
                lo, hi = np.searchsorted(values, keys[:, r]), np.searchsorted(values, keys[:, r], "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    for j in ids[lo[i]: hi[i]].tolist():
                        seen.add((int(row[part[i]]), j, int(start[part[i]])))
            for d, j, s, e in self._merged(seen):
                best = out.get((d, j))
                if best and best[0] == 0:
                    continue
                k = self.edits[j]
                first, last = int(bounds[d]), int(bounds[d + 1])
                a1, b1 = max(first, s - 4 * k - 4), min(last, e + 4 * k + 4)
                while a1 > first and raw[a1] & 0xC0 == 0x80:
                    a1 -= 1
                piece = raw[a1:b1].tobytes()
                at = piece.find(self.texts[j])
                if at >= 0:
                    found = (0, a1 + at, a1 + at + int(self.size[j]))
                else:
                    text = piece.decode("utf-8", "replace")
                    hit = edit_search(self.chars[j], text, k) if k else None
                    if hit is None:
                        continue
                    end = a1 + len(text[: hit[1]].encode())
                    found = (hit[0], max(a1, end - int(self.size[j])), min(end, last))
                if best is None or found < best:
                    out[d, j] = found
        if self.short:
            blob = raw.tobytes()
            for j in self.short:
                for d in range(len(bounds) - 1):
                    at = blob.find(self.texts[j], int(bounds[d]), int(bounds[d + 1]))
                    if at >= 0:
                        out[d, j] = (0, at, at + int(self.size[j]))
        return out

    def _merged(self, seen: set[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(row, item, first byte, end byte) of the candidate windows; those that overlap are verified as one stretch."""
        out: list[list[int]] = []
        for d, j, s in sorted(seen):
            e = s + int(self.size[j])
            if out and out[-1][:2] == [d, j] and s <= out[-1][3]:
                out[-1][3] = max(out[-1][3], e)
            else:
                out.append([d, j, s, e])
        return out

    def _row_signatures(self, raw, bounds, row, start, item) -> np.ndarray:
        """As ``signatures``, with symbols outside the row read as 0."""
        n = len(row)
        width = int(self.size[item].max(initial=0))
        block = np.zeros((n, width), np.uint8)
        step = max(1, GATHER_BYTES // max(1, width))
        for a in range(0, n, step):
            part = row[a: a + step]
            at = start[a: a + step, None] + np.arange(width)
            inside = (at >= bounds[part][:, None]) & (at < bounds[part + 1][:, None])
            block[a: a + step][inside] = raw[at[inside]]
        return self.signatures(block.ravel(), np.arange(n) * width, item)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES) -> list[list[tuple[int, str]]]:
    """The query set in blocks of at most ``most`` bytes of text (one item may exceed it alone)."""
    blocks, size = [[]], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        n = len((r["t"] or "").encode("utf-8", "replace"))
        if blocks[-1] and size + n > most:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"], r["t"]))
        size += n
    return blocks


def _scan(items: Items, column: pa.Array) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, bounds = utf8(column)
    norm, at_bounds, at = normalise(raw, bounds)
    return items.leaks(norm, at_bounds), raw, bounds, at_bounds, at


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", share: float = MAX_EDIT_SHARE) -> DataFrame:
    """One row per (document row, item): the edits of the nearest stretch, and its place in code points of the document."""
    prepare(docs.sparkSession)
    kept = id_and_text(docs, id_col, text_col)

    def scan_block(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, share)
            for batch in batches:
                found, raw, bounds, _, at = _scan(items, batch.column(1))
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                ids = batch.column(0).to_pylist()
                rows = []
                for (d, j), (edits, a, b) in sorted(found.items()):
                    first = int(at[a]) if a < len(at) else int(bounds[d + 1])
                    end = int(at[b - 1]) + 1 if b > a else first
                    base = int(chars[bounds[d]])
                    rows += [(ids[d], i, edits, items.edits[j], int(chars[first]) - base, int(chars[end]) - base) for i in items.ids[j]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in SCHEMA.split(", ")])

        return kept.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, [scan_block(b) for b in item_blocks(benchmark, item_id_col, item_text_col)])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", share: float = MAX_EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, share)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in _scan(items, batch.column(at))[0]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
