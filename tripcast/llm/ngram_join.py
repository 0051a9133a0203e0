"""Operator 9, n-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

1. Order. Shingles are ordered by how many texts hold them (in powers of two, by
   block counts over all texts), rare ones first, then by hash.
2. Candidates. Two sets with the wanted similarity share a shingle among the
   first ``n - ceil(share * n) + 1`` of each. A text whose first shingles are all
   its own links with no other text. The others form candidate groups: connected
   components over shared first shingles. No link leaves its group.
3. Join. The ordered sets of a group are stored in a prefix tree. A set walks
   through it: an edge's overlap is counted once for all sets below, and a
   subtree is left when its overlap plus the shorter remaining length, or its
   lengths alone, cannot reach the bound. Overlaps at leaves are exact. Sets that
   are already connected are not compared again.
4. Large groups are dealt twice to blocks of at most ``GROUP_SHINGLES`` by
   different salts. Most of a group of near copies is connected then; only what
   is not yet part of its largest component meets all blocks in a last round.
5. Components of all links.

Texts are one node; texts with equal sets are one class under their smallest id,
so copies weigh once.

Scale: texts are shuffled once (the exchange is reused by both passes), then 6
bytes for each distinct shingle of a chunk, then the candidates' sets. Memory is
bounded by a chunk, a hash block and a tree block. There is no broadcast, and
links, labels and groups stay distributed.

Defined cases: null and empty texts have no shingles and are their own component;
texts under four words have one shingle; rows under one id are one document; rows
without an id have no component and link nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as bl
from . import textbytes as tb
from .common import empty_safe_size, utf8
from .components import components, written

NGRAM = 4
PERCENT = 85
GROUP_SHINGLES = 1 << 18  # shingles of a tree block
LEAST_SLOTS = 32
SLOT_BYTES = 1 << 20  # candidate sets of a call, many small groups together


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    low = tb.LOWER[raw]
    starts, ends, words = tb.word_spans(low, bounds, tb.NOT_SPACE)
    prefix = tb.Prefix(tb.Prefix(low).stretches(starts, ends))
    grams = prefix.windows(n)
    out = []
    for a, b in zip(words.tolist(), words[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a: b - n + 1]))
        elif b > a:  # the whole sequence is one shingle, unlike any longer one
            out.append(tb.mix(prefix.stretches(np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of sets of a and b elements with percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """A path-compressed tree over sequences that ascend in a common order."""

    def __init__(self, sequences: list[np.ndarray]):
        coded = [s.astype(">u4").tobytes() for s in sequences]
        self.order = sorted(range(len(sequences)), key=coded.__getitem__)
        self.rows = [sequences[i] for i in self.order]
        self.size = [len(r) for r in self.rows]
        # node: [first leaf, end leaf, depth where its edge starts, depth where it ends, children]
        shared = [0] * (len(self.rows) + 1)
        for i in range(1, len(self.rows)):
            x, y = self.rows[i - 1], self.rows[i]
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            shared[i] = int(differ[0]) if len(differ) else k
        self.root = self._node(0, len(self.rows), 0, shared)

    def _node(self, first: int, end: int, depth: int, shared: list[int]) -> list:
        """Iterative build: a node's edge runs to the least shared depth of its leaves."""
        root: list = []
        todo = [(first, end, depth, root)]
        while todo:
            a, b, d, into = todo.pop()
            stop = min(shared[a + 1: b], default=self.size[a])
            stop = max(stop, d)
            node = [a, b, d, stop, [], max(self.size[a:b]), min(self.size[a:b])]
            into.append(node)
            if b - a > 1:
                cuts = [a, *(i for i in range(a + 1, b) if shared[i] <= stop), b]
                todo += [(x, y, stop, node[4]) for x, y in zip(cuts, cuts[1:])]
        return root[0]

    def search(self, probe: int, vocabulary: int, skip, found, percent: int = PERCENT) -> None:
        """Calls ``found(leaf)`` for every leaf after ``probe`` that is similar enough; ``skip(leaf)`` leaves one out."""
        x = self.rows[probe]
        n = len(x)
        has = np.zeros(vocabulary, bool)
        has[x] = True
        longest, shortest = 100 * n // percent, -(-percent * n // 100)
        todo = [(child, 0) for child in ([self.root] if self.root[3] or self.root[1] - self.root[0] == 1 else self.root[4])]
        while todo:
            (a, b, d, stop, children, most, least), overlap = todo.pop()
            if b <= probe + 1 or most < shortest or least > longest:
                continue
            leaf = b - a == 1
            if leaf and (a == probe or skip(a)):
                continue
            row = self.rows[a]
            end = len(row) if leaf else stop
            if end > d:
                overlap += int(np.count_nonzero(has[row[d:end]]))
            if leaf:
                if overlap >= needed(n, end, percent) and overlap:
                    found(a)
                continue
            rest = n - int(np.searchsorted(x, row[stop - 1], "right")) if stop else n
            if overlap + min(rest, most - stop) < needed(n, max(least, shortest), percent):
                continue
            todo += [(c, overlap) for c in children]


def join_sets(ids: list[int], sets: list[np.ndarray], ranks: list[np.ndarray], labels: list[int] | None = None,
              wanted: list[bool] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what the sets' similarity connects. Sets under one label count as connected; only pairs with a
    ``wanted`` set on one side are compared."""
    every = np.unique(np.concatenate([(r.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)) for s, r in zip(sets, ranks)]))
    rows = [np.sort(np.searchsorted(every, (r.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)))) for s, r in zip(sets, ranks)]
    tree = PrefixTree(rows)
    parent = list(range(len(ids)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = tree.order
    if labels is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            parent[top(i)] = top(first.setdefault(label, i))
    links = []
    left = {top(i) for i in range(len(ids))}
    for p in range(len(at)):
        i = at[p]
        if len(left) == 1:
            break

        def skip(leaf: int) -> bool:
            j = at[leaf]
            return top(j) == top(i) or (wanted is not None and not (wanted[i] or wanted[j]))

        def found(leaf: int) -> None:
            j = at[leaf]
            links.append((ids[i], ids[j]))
            left.discard(top(j))
            parent[top(j)] = top(i)
            left.add(top(i))

        tree.search(p, len(every), skip, found, percent)
    return links


SETS = "sha string, doc_id long, n long, class string, first array<long>, shingles binary"


def _links(groups: DataFrame, slots: int, percent: int) -> DataFrame:
    """Links inside every group (columns grp, node, shingles, label, wanted); many small groups share a call."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[str, list[int]] = {}
        for i, g in enumerate(table["grp"].to_pylist()):
            by.setdefault(g, []).append(i)
        ids, blobs = table["node"].to_pylist(), table["shingles"].to_pylist()
        labels, wanted = table["label"].to_pylist(), table["wanted"].to_pylist()
        out: list[tuple[int, int]] = []
        for members in by.values():
            if len(members) > 1:
                members.sort(key=lambda i: (ids[i], blobs[i]))
                parts = [bl.unpack(blobs[i], np.uint64, np.uint8) for i in members]
                out += join_sets([ids[i] for i in members], [p[0] for p in parts], [p[1] for p in parts],
                                 [labels[i] for i in members], [wanted[i] for i in members], percent)
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate("ab")})

    keyed = groups.withColumn("slot", F.pmod(F.xxhash64("grp"), F.lit(slots)))
    return keyed.groupBy("slot").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, percent: int = PERCENT,
                      group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``sha`` tells texts apart."""
    base, texts, total = bl.chunked(docs, id_col, text_col)
    blocks = bl.n_blocks(total)

    def send_counts(table: pa.Table) -> pa.Table:
        chunk = bl.Chunk(table)
        sets = shingle_sets(chunk.raw, chunk.bounds, n)
        keys, count = np.unique(bl.block_key(np.concatenate([np.zeros(0, np.uint64), *sets]), blocks), return_counts=True)
        block, at = bl.by_block(keys)
        low, count = keys.astype(np.uint32), np.minimum(count, 65_535).astype(np.uint16)
        return bl.rows(block.tolist(), chunk.number, [bl.pack(low[a:b], count[a:b]) for a, b in zip(at, at[1:])])

    def add_counts(table: pa.Table) -> pa.Table:
        """Order rank of every shingle: 0 for one text, else the next power of two of its texts."""
        parts = [bl.unpack(b, np.uint32, np.uint16) for b in table["blob"].to_pylist()]
        every, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        held = np.bincount(which, np.concatenate([p[1] for p in parts]), len(every))
        rank = np.minimum(np.ceil(np.log2(np.maximum(held, 1))), 62).astype(np.uint8)[which]
        cut = np.cumsum([len(p[0]) for p in parts])[:-1]
        return pa.table({"block": table["block"], "chunk": table["chunk"], "blob": pa.array([x.tobytes() for x in np.split(rank, cut)], pa.binary())})

    def order_sets(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: dict[str, list] = {f.split()[0]: [] for f in SETS.split(", ")}
        if len(left):
            chunk = bl.Chunk(left)
            sets = shingle_sets(chunk.raw, chunk.bounds, n)
            codes = bl.block_key(np.concatenate([np.zeros(0, np.uint64), *sets]), blocks)
            keys, which = np.unique(codes, return_inverse=True)
            rank = bl.answers(keys, right)[which]
            at = 0
            for sha, doc_id, s in zip(chunk.sha, chunk.ids.tolist(), sets):
                r = rank[at: at + len(s)]
                at += len(s)
                first = blob = key = None
                if len(s):
                    head = len(s) - -(-percent * len(s) // 100) + 1
                    order = np.lexsort((s, r))[:head]
                    order = order[r[order] > 0]
                    if len(order):
                        first, blob = s[order].view(np.int64), bl.pack(s, r)
                        key = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()
                for k, v in zip(columns, (sha, doc_id, len(s), key, first, blob)):
                    columns[k].append(v)
        kinds = dict(zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    by_chunk = texts.groupBy("chunk")
    ranks = by_chunk.applyInArrow(send_counts, bl.ROW).groupBy("block").applyInArrow(add_counts, bl.ROW)
    sets = written(by_chunk.cogroup(ranks.groupBy("chunk")).applyInArrow(order_sets, SETS), "sets")

    # one node for each distinct set: the smallest id of its texts
    classes = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("node"))
    nodes = sets.join(classes, "class").where("doc_id = node").select("node", "n", "first", "shingles")

    # candidate groups: nodes that share one of their first shingles
    held = nodes.select("node", F.explode("first").alias("shingle"))
    least = held.groupBy("shingle").agg(F.min("node").alias("m"))
    groups = components(held.join(least, "shingle").where("node > m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct())
    weight = nodes.join(groups, "node")
    sizes = weight.groupBy("component").agg((F.floor(F.sum("n") / group_shingles) + 1).cast("long").alias("parts"))
    member = written(weight.join(sizes, "component").select("component", "parts", "node", "shingles"), "candidates")
    slots = max(LEAST_SLOTS, empty_safe_size(member, F.octet_length("shingles").cast("long")) // SLOT_BYTES)

    salts = F.explode(F.when(F.col("parts") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    dealt = member.select("*", salts.alias("salt")).select(
        F.concat_ws("|", "component", "salt", F.pmod(F.xxhash64("node", "salt"), F.col("parts"))).alias("grp"),
        "node", "shingles", F.col("node").alias("label"), F.lit(True).alias("wanted"))
    links = written(_links(dealt, slots, percent), "links")
    labels = components(links)

    # large groups: what is not in the largest component so far meets all blocks
    large = (member.where("parts > 1").join(labels.withColumnRenamed("component", "label"), "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    shares = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("k"))
    main = shares.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    large = large.join(main, "component").withColumn("rest", F.col("label") != F.col("main"))
    rest = large.where("rest").groupBy("component").agg((F.floor(F.sum(F.octet_length("shingles") / 9) / group_shingles) + 1).cast("long").alias("rest_parts"))
    last = written(large.join(rest, "component"), "rest")
    if last.take(1):
        block = F.pmod(F.xxhash64("node"), F.col("parts"))
        own = F.pmod(F.xxhash64("node"), F.col("rest_parts"))
        as_any = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1)).alias("i"), block.alias("j"), "component", "node", "shingles", "label", F.lit(False).alias("wanted"))
        as_rest = last.where("rest").select(own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), "component", "node", "shingles", "label", F.lit(True).alias("wanted"))
        pairs = as_any.unionByName(as_rest).select(F.concat_ws("|", "component", "i", "j").alias("grp"), "node", "shingles", "label", "wanted")
        pairs = pairs.groupBy("grp", "node").agg(F.max_by("shingles", "wanted").alias("shingles"), F.min("label").alias("label"), F.max("wanted").alias("wanted"))
        more = _links(pairs, slots, percent)
        labels = components(links.unionAll(more))

    shared = sets.where("class is not null").select("sha", "n", "class").join(classes, "class").join(labels, "node", "left")
    placed = (shared.select("sha", "n", F.coalesce("component", "node").alias("component"))
              .unionAll(sets.where("class is null").select("sha", "n", F.col("doc_id").alias("component"))))
    with_id = base.where("doc_id is not null").select("doc_id", "sha").join(placed, "sha").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    without = base.where("doc_id is null").select("doc_id", "text").mapInArrow(lambda it: _alone(it, n), "doc_id long, n_shingles long, component_id long")
    return with_id.unionByName(without)


def _alone(batches, n: int):
    """Rows without an id: their set's size, and no component."""
    for batch in batches:
        size = [len(s) for s in shingle_sets(*utf8(batch.column(1)), n)]
        none = pa.array([None] * len(size), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(size, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; one row for each id (of
    the smallest text hash). Rows without an id stay."""
    found = similar_documents(docs, id_col, text_col, **options)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    known = known.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")
    return known.unionByName(docs.where(F.col(id_col).isNull()))
