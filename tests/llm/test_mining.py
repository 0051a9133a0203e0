"""Toxicity, phrase collocations and hard negatives against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from llm_cases import WORDS, awkward, empty, prose
from tripcast.llm import hard_negatives as N
from tripcast.llm import phrases as P
from tripcast.llm import queries
from tripcast.llm import toxicity as T
from tripcast.llm.count_automaton import Automaton, Builder, compose, prefix_hash, range_of, union

# ---------------------------------------------------------------- toxicity

BAD = ["scumbag", "worthless", "moronic", "disgusting"]


def labelled(n, seed, bad=BAD):
    """Texts of which every third has two or three of the words in ``bad``."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng.randrange(20, 200), rng.random()).split()
        if i % 3 == 0:
            for _ in range(rng.randrange(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_toxicity_learns_words_and_their_misspellings():
    rows = labelled(600, 1)
    model = T.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    held = labelled(300, 2)
    p = model.scores(pa.array([t for _, t, _ in held], pa.large_string()))
    assert np.mean((p >= 0.5) == np.array([y for *_, y in held])) >= 0.98
    # spellings that training never saw lie nearer to their words than any ordinary word does
    value = lambda words: model.logits(T.words_of(pa.array(words, pa.large_string())))
    plain = value(sorted(set(WORDS)))
    assert value(["worthles", "disgustingg", "moronnic", "scumbags", "wworthless"]).min() > plain.max()
    # one insult counts in a text of any length, and the order of rows does not matter
    long = prose(20_000, 3)
    low, high = model.scores(pa.array([long, long + " scumbag worthless scumbag"], pa.large_string()))
    assert low < 0.5 <= high
    again = model.scores(pa.array([t for _, t, _ in held][::-1], pa.large_string()))
    assert np.allclose(again[::-1], p)


def test_toxicity_subwords_are_those_of_each_word():
    words = ["a", "über", "scum", "über"]
    column = pa.array([" ".join(words), "", "Scum!"], pa.large_string())
    w = T.words_of(column)
    alone = {x: sorted(T.words_of(pa.array([x], pa.large_string())).grams.tolist()) for x in set(words)}
    got = [sorted(w.grams[w.bounds[i]: w.bounds[i + 1]].tolist()) for i in w.of]
    assert got == [alone[x] for x in ("a", "über", "scum")] + [alone["scum"]]  # a word that just occurred is left out
    assert w.rows.tolist() == [0, 3, 3, 4] and len(alone["scum"]) == 4 + 3 + 2 + 1
    start, end, row = T.windows(np.array([0, 0, 3, 30]), 8, 4)
    for r, (a, b) in enumerate(((0, 0), (0, 3), (3, 30))):
        assert set(range(a, b)) == {x for s, e, q in zip(start, end, row) if q == r for x in range(s, e)}


def test_toxicity_query_and_cases(spark):
    rows = labelled(200, 4)
    docs, _ = awkward(spark, [(100 + i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(100 + i, 1, y) for i, _, y in rows] + [(1, 1, 0), (None, 1, 1), (5, 0, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(r["held_out"] is None for r in got if r["doc_id"] is None)
    # labels of held-out rows are never read
    turned = [(100 + i, 1, 1 - y if zlib.crc32(str(100 + i).encode()) % 5 == 0 else y) for i, _, y in rows]
    other = T.toxicity(docs, spark.createDataFrame([*turned, (1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(map(key, got)) == sorted(map(key, other))
    none = T.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert T.toxicity(empty(spark), labels).count() == 0


def test_toxicity_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in queries.op11_toxicity(spark, "/root/testdata/sf0.1").collect()}
    y = duckdb.execute("SELECT doc_id, toxic, lang FROM '/root/testdata/sf0.1/labels.parquet' JOIN '/root/testdata/sf0.1/documents.parquet' USING (doc_id)").fetchall()
    held = [(t, found[i]["predicted"], lang) for i, t, lang in y if found[i]["held_out"]]
    english = [(t, p) for t, p, lang in held if lang == "en"]
    assert np.mean([p for t, p in english if t]) >= 0.75 and np.mean([p for t, p in english if not t]) <= 0.03
    assert np.mean([t == p for t, p, _ in held]) >= 0.94


# ---------------------------------------------------------------- phrase collocations


def plain_phrases(rows, min_count, max_words=5, top=2000, percent=100):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = {}
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside.get(p[i:i + m], 0), a)
        scored = []
        for p, a in cands.items():
            if 100 * inside.get(p, -1) >= percent * a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    few = ["new", "york", "New", "city", "ca\x00fé", "été", "of", "the"]
    rows = []
    for _ in range(n):
        w = [rng.choice(few) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(0, 40))]
        rows.append((" ".join(w), rng.choice(["en", "fr", None, ""])))
    return rows


def test_phrases_against_plain_counts(spark):
    rows = phrase_rows(1, 300) + [(None, "en"), ("", None), ("york new york new york " * 2000, "en"), ("a b c d e f g " * 5, "de"), ("x\x0by\x0cz", "de")]
    docs = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int, a int")
    for least, words, top, percent in ((3, 5, 2000, 100), (5, 3, 7, 60), (1, 2, 50, 100), (400, 5, 2000, 100)):
        got = sorted(tuple(r) for r in P.phrases(docs.repartition(5), min_count=least, max_words=words, top=top, keep_percent=percent).collect())
        assert got == plain_phrases(rows, least, words, top, percent)
    none = spark.createDataFrame([], docs.schema)
    assert P.phrases(none).count() == 0


def test_phrases_union_in_rounds(spark):
    """More shards than one union takes: two rounds over ever finer ranges."""
    rows = phrase_rows(2, 400)
    docs = spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string").repartition(80)
    got = sorted(tuple(r) for r in P.phrases(docs, min_count=4).collect())
    assert got == plain_phrases(rows, 4)


def test_automata():
    rng = random.Random(3)
    lists = [Counter(tuple(rng.choice([b"a", b"b", b"", b"cc"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)) for _ in range(4)]
    parts = []
    for counts in lists:
        builder = Builder()
        for path in sorted(counts):
            builder.add(path, counts[path])
        parts.append(Automaton(builder.finish()))
        assert list(parts[-1].sequences()) == sorted(counts.items())
        tails = {(counts[p],) + tuple(sorted((q[len(p):], c) for q, c in counts.items() if q[:len(p)] == p and q != p)) for p in {q[:i] for q in counts for i in range(len(q) + 1)}}
        assert len(parts[-1].weights) <= len(tails)  # equal futures are one state (the root may be one more)
    total = sum(lists, Counter())
    assert list(union(parts)) == sorted(total.items())
    asked = Builder()
    some = sorted({*list(total)[:20], (b"zz",), (b"a", b"zz")})
    for path in some:
        asked.add(path, 1)
    whole = Builder()
    for path, n in union(parts):
        whole.add(path, n)
    assert list(compose(Automaton(asked.finish()), Automaton(whole.finish()))) == [(p, total[p]) for p in some if p in total]
    codes = np.array([5, 1 << 31], np.uint64)
    assert prefix_hash([codes, codes]).tolist() == [prefix_hash([5, 5]), prefix_hash([1 << 31, 1 << 31])]
    assert range_of((b"en", b"a", b"b", b"c"), 12) >> 6 == range_of((b"en", b"a", b"b"), 6)


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, is_anchor, n_pos=5, n_neg=10, low=30, high=90):
    out = []
    usable = [(i, y, [int(np.floor(256.0 * x)) for x in v]) for i, y, v in rows
              if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {(i, y, tuple(v)) for i, y, v in usable if is_anchor(i)}
    for a, ya, va in anchors:
        score = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, y, v in usable if len(v) == len(va)]
        for s, i, _ in sorted(x for x in score if x[2] == ya and x[1] != a)[:n_pos]:
            fits = sorted(x for x in score if x[2] != ya and low * -s <= 100 * -x[0] <= high * -s)[:n_neg]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, dim=6, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.4, (labels + 3, dim))
    return [(i, int(rng.integers(labels)), [float(np.float32(x)) for x in centre[rng.integers(labels + 3)] + rng.normal(0, 0.2, dim)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, tile string, score int, block int")


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rows = vectors(1, 900)
    rows += [(5000 + i, 1, rows[7][2]) for i in range(300)]  # one vector holds a quarter of the rows
    rows += [(100, 2, rows[3][2]), (200, *rows[200][1:]), (6000, None, rows[0][2]), (6100, 1, None), (6200, 1, [1.0, None]), (6300, 1, [float("nan")] * 6),
             (6400, 1, [float("inf")] + [0.0] * 5), (None, 1, rows[0][2]), (6500, 1, [0.5, 0.5]), (6501, 2, [0.5, 0.25]), (6502, 1, [0.5, 0.5]), (6600, 1, []), (6700, 2, [])]
    df = frame(spark, rows).repartition(4)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for tile, options in ((8192, {}), (100, {}), (100, {"n_positives": 2, "n_negatives": 3, "low": -50, "high": 200})):
        monkeypatch.setattr(N, "TILE_ROWS", tile)
        monkeypatch.setattr(N, "SLICE_TILES", 3)
        got = N.hard_negatives(df, **options)
        assert got.columns == cols
        names = {"n_positives": "n_pos", "n_negatives": "n_neg"}
        exp = plain_negatives(rows, lambda i: i % 100 == 0, **{names.get(k, k): v for k, v in options.items()})
        assert sorted(tuple(r) for r in got.collect()) == exp
    assert N.hard_negatives(frame(spark, [])).count() == 0


def test_hard_negatives_exact_large_scores(spark):
    rows = [(i, i % 3, [float(x * 200_000.0 * (i % 7 + 1) + (i * 37 % 11)) for x in (1, 2, i % 5)]) for i in range(60)]
    got = sorted(tuple(r) for r in N.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), is_anchor=N.F.col("id") % 20 == 0).collect())
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and max(r[4] for r in got) > 2**53


def test_packed_tree_bounds_and_pruning():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-20, 20, (500, 4)) + c for c in ([300, 0, 0, 0], [0, 300, 0, 0], [0, 0, -300, 0])]).astype(np.int64)
    label = rng.integers(0, 3, len(v))
    tree = N.RTree(np.arange(len(v)), label, v)
    assert sorted(tree.ids.tolist()) == list(range(len(v)))
    q = rng.integers(-50, 50, (5, 4))
    asked = tree.asked(q)
    for level, (lower, upper) in enumerate(asked.bounds):
        rows = N.LEAF * N.FANOUT**level
        for node in range(lower.shape[1]):
            s = tree.v[node * rows: (node + 1) * rows] @ q.T
            assert (s >= lower[:, node]).all() and (s <= upper[:, node]).all()
    # a clustered table is searched in part only
    reads = []

    class Rows(np.ndarray):
        def __getitem__(self, key):
            reads.append(key)
            return np.asarray(super().__getitem__(key))

    one = tree.asked(np.array([[10, 0, 0, 0]]))
    tree.search(one._replace(v=one.v.view(Rows)), 0, 1, -1, True, [(-N.NO_LIMIT, N.NO_LIMIT)], 5)
    assert 0 < len(reads) < len(v) / N.LEAF / 2


def test_cuts_place_every_row_in_bounded_tiles():
    rng = np.random.default_rng(6)
    v, label, tie = rng.integers(-100, 100, (4000, 8)), rng.integers(0, 3, 4000), rng.integers(0, 1 << 30, 4000)
    v[:1500], label[:1500] = v[0], 1
    cuts = N.Cuts(label, v, tie, 40)
    size = np.bincount(cuts.of(label, v, tie), minlength=cuts.tiles)
    assert size.sum() == 4000 and size.max() <= 400


def test_mining_queries_read_whole_tables(spark):
    n = duckdb.execute(f"SELECT count(*) FROM '{SF_SMALL}/documents.parquet'").fetchone()[0]
    assert queries.op11_toxicity(spark, SF_SMALL).count() == n


def test_longer_phrases_need_frequent_triples():
    """N-grams of three words and more leave a shard only if their triples may be frequent."""
    t = P.Tokens(pa.array(["a b c a b c x a b"], pa.large_string()), pa.array(["en"]))
    none, every = np.zeros(P.FILTER_BITS // 8, np.uint8), np.full(P.FILTER_BITS // 8, 255, np.uint8)
    of_abc = none.copy()
    h = t.triples(*t.pairs(np.ones(len(t.hash), bool)), every)[1][:1]
    at = int(h[0] % np.uint64(P.FILTER_BITS))
    of_abc[at >> 3] |= np.uint8(1 << (at & 7))
    for triples, third in ((none, 0), (of_abc, 2), (every, 7)):
        shard = P.Shard()
        shard.add(t, every, every, triples)
        levels = shard.levels(3)[2]
        assert int(levels[1][2].sum()) == 8 and int(levels[2][2].sum()) == third
