"""Operator 12, phrase collocations: n-gram counts in weighted acyclic automata.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces, and
those into words. All counts are per language. Candidates are phrases of 2 to
``max_words`` words with at least ``min_count`` occurrences; the weakest cut of a
phrase into two parts gives its score ``floor(1000 * a * n / (l * r))``. A candidate
goes if a longer one around it occurs as often (``keep_percent``); each language's
first ``top`` are returned.

Method: every shard of texts builds automata from its sorted n-grams, one for each
range of prefixes (language and first two words, by hash). Automata of the same
range are united and their weights added, ``FAN_IN`` shards at a time; each round
cuts the ranges ``FAN_IN`` times finer, so one union never holds more than about a
shard, whatever the corpus. The last round drops sequences below ``min_count`` with
all that extends them. Counts of phrase parts come from composing an automaton of
the parts asked for with the counts of their range.

Before that, three scans count words, then pairs of frequent words, then triples of
frequent pairs by hash (partial sums before the shuffle). What reaches ``min_count`` sets bits in a filter
of ``FILTER_BITS`` bits, a fixed size at any input. A collision only lets too much
through, and a phrase can't be more frequent than its words, pairs and triples, so no
candidate is lost; the automata's counts are exact.

Skew: a frequent prefix is one path per shard automaton, however often it occurs.
The joins on phrase parts are equi-joins that Spark may split. The ranked window
has a row limit before its exchange.

Defined cases: null text is empty; a null language is ``und``; repeated rows count
each; ties are ordered as stated; an empty table gives no rows; other columns are
ignored. Scores are whole numbers of any size (decimals of 38 digits inside).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import prepare, utf8
from .components import written
from .count_automaton import Automaton, Builder, compose, label_code, prefix_hash, range_of, union

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
#: Bits of the filters of frequent words, pairs and triples: 8 MB each, at any input.
FILTER_BITS = 1 << 26
_BITMAP = 1 << 15
#: Leading bits of a pair's or triple's hash that are kept: 32 of them travel with each pair, 6 with each range.
PAIR_BITS = 38
#: Frequent words or pairs of a shard; automata (and prefix ranges) that one union joins.
SHARD_WORDS = 1 << 21
RANGE_BITS = 6
FAN_IN = 1 << RANGE_BITS

_END = np.zeros(256, bool)
_END[list(b".,;:!?")] = _END[0x0A:0x0E] = True
_WORD = ~_END
_WORD[[0x20, 0x09]] = False
_PAIR = np.uint64(0xD1342543DE82EF95)


class Tokens:
    """Words of a batch: distinct words, word and row of every occurrence, and whether the next one follows in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, bounds = utf8(texts)
        raw = tb.LOWER[raw]
        starts, ends, rows = tb.word_spans(raw, bounds, _WORD)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[_WORD[raw]])]).dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = tb.row_of(rows)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        cuts = np.concatenate([[0], np.cumsum(_END[raw])])[starts]
        self.follows = np.zeros(len(row), bool)
        self.follows[:-1] = (row[1:] == row[:-1]) & (cuts[1:] == cuts[:-1])
        of_words, of_langs = self._hash(*utf8(self.words)), self._hash(*utf8(pa.array([x.encode() for x in self.langs], pa.large_binary())))
        self.hash = tb.mix(of_words[self.word] ^ tb.mix(of_langs[self.lang])) if len(row) else np.zeros(0, np.uint64)

    @staticmethod
    def _hash(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return tb.Prefix(raw).stretches(bounds[:-1], bounds[1:])

    def pairs(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of pairs of frequent words, their hashes of PAIR_BITS bits)."""
        at = np.flatnonzero(self.follows & hot & np.append(hot[1:], False))
        return at, tb.mix(self.hash[at] * _PAIR + self.hash[at + 1]) >> np.uint64(64 - PAIR_BITS)

    def triples(self, at: np.ndarray, h: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of triples whose two pairs are frequent, their hashes of PAIR_BITS bits); ``at`` and ``h`` are the pairs."""
        linked = np.zeros(len(self.hash) + 1, bool)
        linked[at[_in(pairs, h)]] = True
        at = np.flatnonzero(linked[:-1] & linked[1:])
        h = tb.mix(self.hash[at] * _PAIR + self.hash[at + 1])
        return at, tb.mix(h * _PAIR + self.hash[at + 2]) >> np.uint64(64 - PAIR_BITS)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


_BLOBS = "prefix long, source long, blob binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["prefix", "source", "blob"])


def _sources(texts: DataFrame, n_words: int) -> int:
    """How many shards there may be: a shard ends with its partition or with SHARD_WORDS words. Reads no column."""
    return texts.select(F.spark_partition_id().alias("p")).distinct().count() + n_words // SHARD_WORDS


def _rounds(rows: DataFrame, sources: int, joiner: Callable) -> tuple[DataFrame, int]:
    """(rows, bits): one blob for each prefix of ``bits`` bits. Every round joins ``FAN_IN`` of the ``sources`` of a prefix and
    cuts the prefixes ``FAN_IN`` times finer, so that a group stays as large as about one source was, at any number of them."""
    bits = RANGE_BITS
    while True:
        last = sources <= FAN_IN
        bits += 0 if last else RANGE_BITS
        sources = 1 if last else -(-sources // FAN_IN)
        grouped = rows.withColumn("source", F.pmod(F.xxhash64("source"), F.lit(sources))).groupBy("prefix", "source")
        rows = written(grouped.applyInArrow(joiner(last, bits), _BLOBS), "joined")
        if last:
            return rows, bits


def _filter(frequent: DataFrame) -> Broadcast:
    """Bits of the hashes ``h``: at most FILTER_BITS / 8 bytes reach the driver and each executor."""
    at = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    rows = (frequent.select(F.floor(at / _BITMAP).cast("int").alias("part"), (at % _BITMAP).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, some in rows:
        bits[part * (_BITMAP // 8): (part + 1) * (_BITMAP // 8)] = np.frombuffer(bytes(some), np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, h, c): occurrences by word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tokens(batch.column(0), batch.column(1))
            _, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            langs = pa.DictionaryArray.from_arrays(pa.array(t.lang[first], pa.int32()), pa.array(t.langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(t.hash[first].view(np.int64)), pa.array(n, pa.int64())], ["lang", "h", "c"])

    return texts.mapInArrow(run, "lang string, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c"))


def _pack_pairs(h: np.ndarray, n: np.ndarray, most: int) -> bytes:
    """Sorted pair hashes of one range and their counts (no higher than ``most``): byte planes, which compress well."""
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    kind = np.uint8 if most < 256 else np.int64
    return b"".join([np.array([len(h), int(h[0]) >> 32], np.int64).tobytes(), np.ascontiguousarray(low.view(np.uint8).reshape(-1, 4).T).tobytes(), np.minimum(n, most).astype(kind).tobytes()])


def _unpack_pairs(blob: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    n, high = np.frombuffer(blob, np.int64, 2).tolist()
    low = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, 16).reshape(4, n).T).view(np.uint32).ravel()
    counts = np.frombuffer(blob, np.uint8 if most < 256 else np.int64, n, 16 + 4 * n)
    return low.astype(np.uint64) | np.uint64(high << 32), counts.astype(np.int64)


def _pair_rows(h: np.ndarray, n: np.ndarray, source: int, bits: int, most: int) -> pa.Table:
    """(prefix, source, blob) by the leading ``bits`` of the hashes (sorted)."""
    prefix = (h >> np.uint64(PAIR_BITS - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(prefix, prepend=-1))
    parts = [(int(prefix[a]), source, _pack_pairs(h[a:b], n[a:b], most)) for a, b in zip(at, np.append(at[1:], len(h)))]
    return _packed(parts)


def _frequent_pairs(texts: DataFrame, words: Broadcast, min_count: int, sources: int, pairs: Broadcast | None = None) -> DataFrame:
    """(h): hashes of the pairs of frequent words (with ``pairs``: of the triples of frequent pairs) with at least ``min_count``
    occurrences. Sorted hashes of a shard travel by range and meet ``FAN_IN`` shards at a time, as the automata do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if size:
                yield from _pair_rows(*np.unique(np.concatenate(held), return_counts=True), source, RANGE_BITS, min_count).to_batches()

        for batch in batches:
            t = Tokens(batch.column(0), batch.column(1))
            found = t.pairs(_in(words.value, t.hash))
            held.append((found if pairs is None else t.triples(*found, pairs.value))[1])
            size += len(held[-1])
            if size >= SHARD_WORDS:
                yield from out()
                source, held, size = source + 1, [], 0
        yield from out()

    def joiner(last: bool, bits: int):
        def join(key: tuple, table: pa.Table) -> pa.Table:
            h, n = map(np.concatenate, zip(*(_unpack_pairs(x, min_count) for x in table["blob"].to_pylist())))
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.diff(h, prepend=h[0] + np.uint64(1)))
            h, n = h[at], np.add.reduceat(n, at)
            keep = n >= (min_count if last else 1)
            return _pair_rows(h[keep], n[keep], key[1].as_py(), bits, min_count)

        return join

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_pairs(blob, min_count)[0].view(np.int64))], ["h"])

    return _rounds(texts.mapInArrow(run, _BLOBS), sources, joiner)[0].select("blob").mapInArrow(listed, "h long")


class Shard:
    """Frequent words of some batches, with links to the next word where the pair is frequent, and to the one after it where
    the triple is."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.langs: dict[bytes, int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, t: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray | None = None) -> None:
        hot = _in(words, t.hash)
        at, h = t.pairs(hot)
        linked, longer = np.zeros(len(hot), bool), np.zeros(len(hot), bool)
        linked[at[_in(pairs, h)]] = True
        if triples is not None:
            at, h = t.triples(at, h, pairs)
            longer[at[_in(triples, h)]] = True
        keep = np.flatnonzero(hot)
        used, place = np.unique(t.word[keep], return_inverse=True)
        number = np.array([self.words.setdefault(w, len(self.words)) for w in t.words.take(pa.array(used)).to_pylist()], np.int64)
        lang = np.array([self.langs.setdefault(x.encode(), len(self.langs)) for x in t.langs], np.int64)
        self.parts.append((number[place] if len(keep) else np.zeros(0, np.int64), lang[t.lang[keep]] if len(keep) else np.zeros(0, np.int64), linked[keep], longer[keep]))
        self.size += len(keep)

    def levels(self, max_words: int) -> tuple[list[bytes], list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(languages, words, levels) in sorted order; a level has (parent, last word, count) of its distinct n-grams, sorted."""
        langs, words = sorted(self.langs), sorted(self.words)
        of_lang, of_word = np.zeros(len(langs), np.int64), np.zeros(len(words), np.int64)
        of_lang[[self.langs[x] for x in langs]] = np.arange(len(langs))
        of_word[[self.words[x] for x in words]] = np.arange(len(words))
        word = of_word[np.concatenate([p[0] for p in self.parts])]
        code = of_lang[np.concatenate([p[1] for p in self.parts])]
        linked, longer = (np.concatenate([p[i] for p in self.parts]) for i in (2, 3))
        at, levels, v = np.arange(len(word)), [], max(1, len(words))
        for k in range(max_words):
            if k:
                more = linked[at] if k == 1 else longer[at + k - 2]
                at, code = at[more], code[more]
            key, code, n = np.unique(code * v + word[at + k], return_inverse=True, return_counts=True)
            levels.append((key // v, key % v, n))
        return langs, words, levels

    def automata(self, max_words: int) -> Iterator[tuple[int, bytes]]:
        """(prefix range, automaton) of this shard's n-grams."""
        if not self.size:
            return
        langs, words, levels = self.levels(max_words)
        shift = np.uint64(64 - RANGE_BITS)
        lang_code = np.array([label_code(x) for x in langs], np.uint64)
        word_code = np.array([label_code(x) for x in words], np.uint64)
        (lang, first, n1), pairs = levels[0], levels[1] if max_words > 1 else (np.zeros(0, np.int64),) * 3
        ranges = [(prefix_hash([lang_code[lang], word_code[first]]) >> shift).tolist(),
                  (prefix_hash([lang_code[lang[pairs[0]]], word_code[first[pairs[0]]], word_code[pairs[1]]]) >> shift).tolist() if len(pairs[0]) else []]
        names = [*words, *langs]  # languages stand at depth 0 only, so both parts keep their own order there
        builders: dict[int, Builder] = {}
        below = [np.searchsorted(levels[k + 1][0], np.arange(len(levels[k][0]) + 1)).tolist() for k in range(max_words - 1)]
        last = [level[1].tolist() for level in levels]
        count = [level[2].tolist() for level in levels]

        def deeper(k: int, node: int, path: tuple, builder: Builder) -> None:
            if k + 1 < max_words:
                for child in range(below[k][node], below[k][node + 1]):
                    longer = (*path, last[k + 1][child])
                    builder.add(longer, count[k + 1][child])
                    deeper(k + 1, child, longer, builder)

        def builder_of(r: int) -> Builder:
            found = builders.get(r)
            if found is None:
                found = builders[r] = Builder(names)
            return found

        for node, l in enumerate(lang.tolist()):
            path = (len(words) + l, last[0][node])
            builder_of(ranges[0][node]).add(path, count[0][node])
            if max_words > 1:
                for pair in range(below[0][node], below[0][node + 1]):
                    longer = (*path, last[1][pair])
                    builder = builder_of(ranges[1][pair])
                    builder.add(longer, count[1][pair])
                    deeper(1, pair, longer, builder)
        for r, builder in sorted(builders.items()):
            yield r, builder.finish()


def _shards(texts: DataFrame, words: Broadcast, pairs: Broadcast, triples: Broadcast | None, max_words: int) -> DataFrame:
    """(prefix, source, blob): every shard's automata by prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, shard = TaskContext.get().partitionId() << 32, Shard()

        def out(shard: Shard, source: int) -> Iterator[pa.RecordBatch]:
            for r, blob in shard.automata(max_words):
                yield from _packed([(r, source, blob)]).to_batches()

        for batch in batches:
            shard.add(Tokens(batch.column(0), batch.column(1)), words.value, pairs.value, triples.value if triples else None)
            if shard.size >= SHARD_WORDS:
                yield from out(shard, source)
                source, shard = source + 1, Shard()
        yield from out(shard, source)

    return texts.mapInArrow(run, _BLOBS)


def _united(automata: DataFrame, min_count: int, sources: int) -> tuple[DataFrame, int]:
    """(prefix, blob) of the whole corpus, and the bits of its prefixes."""

    def joiner(last: bool, bits: int):
        def join(key: tuple, table: pa.Table) -> pa.Table:
            prefix, source = key[0].as_py(), key[1].as_py()
            builders: dict[int, Builder] = {}
            for path, weight in union([Automaton(x) for x in table["blob"].to_pylist()], min_count if last else 1):
                r = prefix if last else range_of(path, bits)
                if (builder := builders.get(r)) is None:
                    builder = builders[r] = Builder()
                builder.add(path, weight)
            return _packed([(r, source, b.finish()) for r, b in sorted(builders.items())])

        return join

    return _rounds(automata, sources, joiner)


def _cuts(counts: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, a, k, first, first_prefix, rest, rest_prefix): every cut of every phrase of two words or more."""
    names = ["lang", "phrase", "a", "k", "first", "first_prefix", "rest", "rest_prefix"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = []
                for (lang, *words), a in Automaton(blob).sequences():
                    for k in range(1, len(words)):
                        first, rest = words[:k], words[k:]
                        rows.append((lang, b" ".join(words), a, k, b" ".join(first), range_of((lang, *first), bits), b" ".join(rest), range_of((lang, *rest), bits)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    found = counts.select("blob").mapInArrow(run, "lang binary, phrase binary, a long, k int, first binary, first_prefix long, rest binary, rest_prefix long")
    return found.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase", "first", "rest")})


def _part_counts(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(lang, part, f) of all parts of all cuts: an automaton of the parts asked for, composed with the counts of their range."""
    asked = (cuts.select("lang", F.col("first").alias("part"), F.col("first_prefix").alias("prefix"))
             .unionAll(cuts.select("lang", "rest", "rest_prefix")).distinct())

    def look_up(asked: pa.Table, counts: pa.Table) -> pa.Table:
        builder, rows = Builder(), []
        for path in sorted((lang.encode(), *part.encode().split(b" ")) for lang, part in zip(asked["lang"].to_pylist(), asked["part"].to_pylist())):
            builder.add(path, 1)
        if asked.num_rows:
            wanted = Automaton(builder.finish())
            for blob in counts["blob"].to_pylist():
                rows += [(path[0].decode(), b" ".join(path[1:]).decode(), f) for path, f in compose(wanted, Automaton(blob))]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "part", "f"])

    return asked.groupBy("prefix").cogroup(counts.groupBy("prefix")).applyInArrow(look_up, "lang string, part string, f long")


#: floor(1000 * a * n / (l * r)) in decimals: exact up to 10**14 occurrences.
_SCORE = ("(cast(1000 as decimal(4,0)) * cast(a as decimal(14,0)) * cast(n as decimal(15,0)))"
          " div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")


def _inside(scored: DataFrame) -> DataFrame:
    """(lang, phrase, around): the largest count of a longer candidate around a phrase."""
    words = scored.where("size >= 3").select("lang", F.split("phrase", " ").alias("w"), "a", "size")
    length = F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    starts = words.select("*", length.alias("m")).select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    return starts.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
            top: int = TOP, keep_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases."""
    if not (min_count >= 1 and max_words >= 2):
        raise ValueError("phrases need two words, counts start at 1")
    prepare(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    words = written(_word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = _filter(words.where(F.col("c") >= min_count))
    sources = _sources(texts, words.agg(F.sum("c").alias("n")).first()["n"] or 0)
    pairs = _filter(_frequent_pairs(texts, frequent, min_count, sources))
    triples = _filter(_frequent_pairs(texts, frequent, min_count, sources, pairs)) if max_words > 2 else None
    counts, bits = _united(_shards(texts, frequent, pairs, triples, max_words), min_count, sources)
    cuts = _cuts(counts, bits)
    parts = written(_part_counts(counts, cuts), "parts")
    left, right = (parts.select("lang", F.col("part").alias(c), F.col("f").alias(f)) for c, f in (("first", "l"), ("rest", "r")))
    cut = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    cut = cut.select("lang", "phrase", "a", "n", "k", "l", "r", F.expr(_SCORE).alias("score"))
    scored = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("least"))
    scored = written(scored.select("lang", "phrase", "a", "n", "least.l", "least.r", "least.score", F.size(F.split("phrase", " ")).alias("size")), "phrases")
    kept = scored.join(_inside(scored), ["lang", "phrase"], "left").where(F.expr(f"around is null or 100 * around < {int(keep_percent)} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
