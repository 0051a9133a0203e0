"""Operator 13, hard-negative mining: best-first search in STR-packed R-trees.

Vectors are whole numbers (``floor(SCALE * x)``); a score is the inner product with
an anchor. For every anchor the ``n_positives`` best other rows of its label are its
positives, and for every positive the ``n_negatives`` best rows of other labels
whose score lies between ``low`` and ``high`` percent of the positive's score are
the hard negatives. Higher scores come first, equal ones by smaller id.

Rows are packed by sort-tile-recursive order: tiles of the whole table first (by
label, then slab by slab along the coordinates of largest spread), then leaves of
``LEAF`` rows and nodes of ``FANOUT`` children inside a tile. A node keeps the
smallest bounding box of its rows and the interval of its labels. A box gives an
interval of inner products for each coordinate, and their sum bounds every score
below the node. The search takes nodes from a queue by falling upper bound. It drops
boxes whose labels cannot match, whose interval misses every score window, or whose
upper bound is strictly below the k-th best score so far, so ties are never lost.

Scale: anchors are a query set that meets all rows in blocks: every cell of
(anchor block, tile) is one bounded task, the answers of a cell are at most k rows
an anchor, and they are merged by a ranked window. Tiles are cut at boundaries from a
bounded sample of rows (``SAMPLE``; every row is indexed, and the search is exact,
so recall is 1); equal vectors are told apart by a hash of the id, and a tile that
is still larger than ``TILE_ROWS`` is dealt out by that hash, so a vector that holds a
third of all rows fills many tiles. Tiles whose labels can't match a block's anchors
form no cell.

Defined cases: rows with a null id, a null label, a null vector or any null or
non-finite component take no part; repeated rows are rows of their own (a copy of
the anchor's own id is no positive of it); vectors of different lengths have no
score; an anchor without positives has no rows; an empty table gives no rows; other
columns are ignored. Scores must fit a signed 64-bit number: larger ones raise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .components import written

SCALE = 256
#: Rows of a tile, anchors of a block: a cell of both is one task's work and memory.
TILE_ROWS = 8_192
BLOCK_ROWS = 4_096
LEAF, FANOUT = 64, 8
#: Rows of the bounded sample that only places tile boundaries.
SAMPLE = 20_000
#: Coordinates along which tiles are cut, at most.
AXES = 8
#: Vector lengths that get boundaries; values of the id hash that tells equal vectors apart.
LENGTHS, TIES = 16, 1 << 30
#: Anchors whose bounds are held at a time; tiles that one join key of anchors and cells meets.
ASK, SLICE_TILES = 256, 64
NO_LIMIT = 1 << 200
FOUND = "key long, slot int, other_id long, score long"


def clean(df: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, v): usable rows with whole-number components."""
    x = F.col(vector_col)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.col(label_col) if label is None else label
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


class Cuts:
    """Tile boundaries: by label and id hash first, then slab by slab along the chosen coordinates."""

    def __init__(self, label: np.ndarray, v: np.ndarray, tie: np.ndarray, tiles: int):
        spread = v.astype(np.float64).std(0) if len(v) else np.zeros(v.shape[1])
        self.axes = np.argsort(-spread, kind="stable")[:AXES]
        self.tiles = 0
        keys = np.column_stack([label.astype(np.float64), v[:, self.axes].astype(np.float64), tie.astype(np.float64)])
        self.tree = self._cut(keys, 0, max(1, tiles))

    def _cut(self, keys: np.ndarray, level: int, tiles: int):
        if tiles <= 1 or len(keys) < 2:
            self.tiles += 1
            return self.tiles - 1
        left = keys.shape[1] - 1 - level  # levels that may still be cut
        slabs = tiles if left <= 1 else max(2, round(tiles ** (1 / min(left, 3))))
        order = np.lexsort((keys[:, -1], keys[:, level]))
        at = np.unique((np.arange(1, slabs) * len(keys)) // slabs)
        at = at[at > 0]
        bounds = [(keys[order[i], level], keys[order[i], -1]) for i in at]
        parts = np.split(order, at)
        return level, bounds, [self._cut(keys[p], min(level + 1, keys.shape[1] - 2), -(-tiles // slabs)) for p in parts]

    def of(self, label: np.ndarray, v: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Tile of every row."""
        keys = np.column_stack([label.astype(np.float64), v[:, self.axes].astype(np.float64), tie.astype(np.float64)])
        out = np.zeros(len(keys), np.int32)

        def walk(node, rows):
            if not isinstance(node, tuple):
                out[rows] = node
                return
            level, bounds, below = node
            slab = np.zeros(len(rows), np.int64)
            for value, tie_value in bounds:
                slab += (keys[rows, level] > value) | ((keys[rows, level] == value) & (keys[rows, -1] >= tie_value))
            for k, child in enumerate(below):
                if (pick := rows[slab == k]).size:
                    walk(child, pick)

        walk(self.tree, np.arange(len(keys)))
        return out


def str_order(label: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in sort-tile-recursive order: by label, then slabs along the coordinates of largest spread."""
    axes = np.argsort(-v.astype(np.float64).std(0), kind="stable")[:AXES] if v.size else []
    out = []

    def pack(rows, depth):
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == len(axes):
            out.append(rows)
            return
        rows = rows[np.argsort(v[rows, axes[depth]], kind="stable")]
        slabs = leaves if depth == len(axes) - 1 else max(2, round(leaves ** (1 / min(len(axes) - depth, 3))))
        size = leaf * -(-leaves // slabs)
        for k in range(0, len(rows), size):
            pack(rows[k: k + size], depth + 1)

    for value in np.unique(label):
        pack(np.flatnonzero(label == value), 0)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class RTree:
    """A packed tree over the rows of one tile; level 0 are the leaves, the last level is the root."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray):
        order = str_order(label, v)
        self.ids, self.label, self.v = ids[order], label[order], v[order]
        at = np.arange(0, len(order), LEAF)
        low, high = np.minimum.reduceat(self.v, at), np.maximum.reduceat(self.v, at)
        least, most = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        self.levels = [(low, high, least, most)]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((low, high, least, most))
        self.biggest = float(np.abs(self.v).max()) if self.v.size else 0.0

    def asked(self, q: np.ndarray) -> "Asked":
        """Anchors with bounds of their scores below every node. float64 while every partial sum of a score is exact
        in it, else whole numbers of any size."""
        most = (float(np.abs(q).max()) if q.size else 0.0) * self.biggest * max(1, self.v.shape[1])
        kind = np.float64 if most < 2**52 else object
        plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        bounds = []
        for low, high, _, _ in self.levels:
            low, high = low.astype(kind).T, high.astype(kind).T
            bounds.append((plus @ low + minus @ high, plus @ high + minus @ low))
        return Asked(q.astype(kind), self.v.astype(kind), bounds)

    def search(self, asked: "Asked", a: int, label: int, own: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list]:
        """The best k rows of anchor ``a`` in every score window, of its label or of other ones: lists of (score, -id)."""
        top: list[list] = [[] for _ in windows]  # heaps, the worst row first
        least, most = min(w[0] for w in windows), max(w[1] for w in windows)
        queue: list = []  # (-upper bound, level, node)

        def offer(level: int, nodes: range) -> None:
            _, _, first, last = self.levels[level]
            lower, upper = asked.bounds[level]
            for node in nodes:
                possible = first[node] <= label <= last[node] if same else not first[node] == label == last[node]
                if possible and upper[a, node] >= least and lower[a, node] <= most:
                    heapq.heappush(queue, (-upper[a, node], level, node))

        offer(len(self.levels) - 1, range(len(self.levels[-1][0])))
        while queue:
            upper, level, node = heapq.heappop(queue)
            if all(-upper < low or len(t) == k and -upper < t[0][0] for t, (low, _) in zip(top, windows)):
                break  # what is left in the queue has no higher bound
            if level:
                offer(level - 1, range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))))
                continue
            part = slice(node * LEAF, (node + 1) * LEAF)
            score, ids = asked.v[part] @ asked.q[a], self.ids[part]
            fits = (self.label[part] == label) & (ids != own) if same else self.label[part] != label
            for t, (low, high) in zip(top, windows):
                ok = fits & (score >= low) & (score <= high)
                if len(t) == k:
                    ok &= score >= t[0][0]
                for j in np.flatnonzero(ok):
                    item = (int(score[j]), -int(ids[j]))
                    if len(t) < k:
                        heapq.heappush(t, item)
                    elif item > t[0]:
                        heapq.heapreplace(t, item)
        return top


class Asked(NamedTuple):
    """Anchors, a tile's rows in the same number type, and (lower, upper) bounds of every anchor and node by level."""

    q: np.ndarray
    v: np.ndarray
    bounds: list[tuple[np.ndarray, np.ndarray]]


def _cells(tiles: DataFrame, anchors: DataFrame, meets: DataFrame, slices: int, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """The best k rows of every anchor in every cell (anchor block, tile) of ``meets``; given ``positives`` (scores) of an
    anchor, the best k in each window from ``low`` to ``high`` percent of them."""
    cell = ["dim", "tile", "part", "block"]
    rows = tiles.join(meets, ["dim", "tile", "part"]).groupBy(*cell)
    # a block's anchors go to all of its tiles: slices of the tiles bound what one join key makes
    queries = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(meets, ["dim", "block", "slice"]).groupBy(*cell)

    def one(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            tree = RTree(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"]))
            q, keys, labels, ids = _matrix(queries["v"]), *(queries[c].to_pylist() for c in ("key", "label", "id"))
            scores = None if same else queries["positives"].to_pylist()
            for start in range(0, len(q), ASK):
                asked = tree.asked(q[start: start + ASK])
                for a in range(len(asked.q)):
                    i = start + a
                    windows = [(-NO_LIMIT, NO_LIMIT)] if same else [(-(-low * p // 100), high * p // 100) for p in scores[i]]
                    for slot, top in enumerate(tree.search(asked, a, labels[i], ids[i], same, windows, k)):
                        for score, minus_id in top:
                            for column, value in zip(out, (keys[i], slot, -minus_id, score)):
                                column.append(value)
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], ["key", "slot", "other_id", "score"])

    return rows.cogroup(queries).applyInArrow(one, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of all cells in every window, ranked from 1. A row limit per task goes before the exchange."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tiled(rows: DataFrame) -> DataFrame:
    """Rows with (dim, tile, part): about ``TILE_ROWS`` of them at most share all three."""
    rows = rows.withColumn("dim", F.size("v")).withColumn("tie", F.pmod(F.xxhash64("id"), F.lit(TIES)))
    # the most common lengths get boundaries; rows of other lengths are dealt by hash alone
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    cuts = {}
    for dim, n in (r for r in sizes if r["dim"]):
        sample = rows.where((F.col("dim") == dim) & (F.col("tie") < min(TIES, SAMPLE * TIES // n))).limit(2 * SAMPLE).toArrow()
        if sample.num_rows:
            cuts[dim] = Cuts(sample["label"].to_numpy(), _matrix(sample["v"]), sample["tie"].to_numpy(), -(-n // TILE_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim, cut in cuts.items():
                pick = np.flatnonzero(dims == dim)
                if len(pick):
                    some = batch.take(pa.array(pick))
                    tile[pick] = cut.of(some.column("label").to_numpy(), _matrix(some.column("v")), some.column("tie").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    placed = rows.mapInArrow(place, "id long, label long, v array<long>, dim int, tie long, tile int")
    parts = placed.groupBy("dim", "tile").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("parts"))
    return placed.join(parts, ["dim", "tile"]).select("id", "label", "v", "dim", "tile", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int").alias("part"))


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   is_anchor: Column | None = None, label: Column | None = None, n_positives: int = 5, n_negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` (over ``id``) chooses the query rows, by default the ids divisible by 100; ``label`` may replace the
    label column."""
    if n_positives < 1 or n_negatives < 1:
        raise ValueError("at least one positive and one negative")
    prepare(df.sparkSession)
    tiles = written(tiled(clean(df, id_col, vector_col, label_col, label)), "tiles")
    anchors = tiles.where(F.col("id") % 100 == 0 if is_anchor is None else is_anchor).select("id", "label", "v", "dim").distinct()
    sizes = anchors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    anchors = written(anchors.join(sizes, "dim").select("id", "label", "v", "dim", F.monotonically_increasing_id().alias("key"),
                                                        F.pmod(F.xxhash64("id", "label", "v"), F.col("blocks")).cast("int").alias("block")), "anchors")
    tile_labels = tiles.groupBy("dim", "tile", "part").agg(F.min("label").alias("t0"), F.max("label").alias("t1"))
    block_labels = anchors.groupBy("dim", "block").agg(F.min("label").alias("b0"), F.max("label").alias("b1"))
    slices = max(1, -(-tile_labels.count() // SLICE_TILES))
    # one row a cell: tiles x anchor blocks, not rows x rows
    cells = written(tile_labels.join(block_labels, "dim").withColumn("slice", F.pmod(F.xxhash64("tile", "part"), F.lit(slices)).cast("int")), "cells")
    meet = ["dim", "tile", "part", "block", "slice"]
    near = _best(_cells(tiles, anchors, cells.where("t0 <= b1 and b0 <= t1").select(*meet), slices, True, n_positives), n_positives)
    near = written(near, "positives")
    scores = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))  # n_positives at most
    asking = anchors.join(scores.select("key", F.col("s.score").alias("positives")), "key")
    other = cells.where("not (t0 = t1 and b0 = b1 and t0 = b0)").select(*meet)
    far = _best(_cells(tiles, asking, other, slices, False, n_negatives, low, high), n_negatives)
    positives = near.select("key", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (far.select("key", "slot", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives, ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
