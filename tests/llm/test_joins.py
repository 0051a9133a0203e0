"""Near copies, components, benchmark leaks and the pipeline against brute force."""

import random
import re
import sys
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from llm_cases import awkward, empty, prose
from tripcast.llm import decontaminate as D
from tripcast.llm import ngram_join as N
from tripcast.llm import packing, quality, secrets_scan
from tripcast.llm.common import utf8
from tripcast.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, set()).add(s)
    nodes = [(i, s) for i, ss in sets.items() if i is not None for s in ss]
    held = defaultdict(list)
    for k, (_, s) in enumerate(nodes):
        for g in s:
            held[g].append(k)
    parent = {i: i for i, _ in nodes}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, s) in enumerate(nodes):
        for j, o in Counter(j for g in s for j in held[g] if j < k).items():
            if 100 * o >= percent * (len(s) + len(nodes[j][1]) - o):
                a, b = top(i), top(nodes[j][0])
                parent[max(a, b)] = min(a, b)
    return sets, top


def near_copies(seed=5, groups=6, copies=40):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = prose(rng.randrange(60, 220), 700 + g).split()
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = prose(1, rng.random()) + "x"
            rows.append((1000 + len(rows), " ".join(w)))
    return rows


def check_components(got, rows):
    sets, top = brute_components(rows)
    for r in got:
        i = r["doc_id"]
        assert r["n_shingles"] in {len(s) for s in sets[i]}
        if i is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == (top(i) if r["n_shingles"] else i), i
    assert len(got) == len(rows)


def test_join_equals_brute_force(spark):
    df, rows = awkward(spark, near_copies())
    check_components(N.similar_documents(df).collect(), rows)
    assert N.similar_documents(empty(spark)).count() == 0


def test_large_groups_are_split_without_losing_links(spark):
    rows = near_copies(9, 2, 120) + near_copies(11, 1, 60)[:50]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(N.similar_documents(df, group_shingles=2_000).collect(), rows)


def test_one_of_each(spark):
    df, rows = awkward(spark, near_copies(6, 2, 10))
    _, top = brute_components(rows)
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    blank = {i for i, t in rows if i is not None and not (t or "").split()}
    assert ids == Counter({i: 1 for i, _ in rows if i is not None and (i in blank or top(i) == i)}) + Counter({None: 2})


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + k) for k in range(1, 60)] + [(7, 7), (2001, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + k: 1000 for k in range(60)}, 2000: 2000, 2001: 2000}


def edited(text, k, rng):
    c = list(text)
    for _ in range(k):
        p = rng.randrange(len(c))
        kind = rng.randrange(3)
        if kind == 0:
            c[p] = rng.choice("abcdefgh ")
        elif kind == 1:
            c.insert(p, rng.choice("abcdefgh"))
        else:
            del c[p]
    return "".join(c)


def test_recall_against_exact_edit_search():
    rng = random.Random(2)
    bench = duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    items = D.Items(bench)
    texts, truth = [], []
    for share in (0.0, 0.02, 0.05, 0.08, 0.1):
        for j, c in enumerate(items.chars * 3):
            j %= len(items.chars)
            texts.append(prose(40, rng.random()) + " " + edited(c, int(share * len(c)), rng) + " " + prose(30, rng.random()))
            truth.append(j)
    norm, bounds, _ = D.normalise(*utf8(pa.array(texts)))
    found = items.leaks(norm, bounds)
    windows = set(zip(*(x.tolist() for x in items.windows(norm, bounds)[::2])))
    wanted = [(d, j) for d, j in enumerate(truth) if D.edit_search(items.chars[j], D.plain(texts[d]).decode(), items.edits[j])]
    assert len(wanted) > 0.95 * len(truth) and set(wanted) <= windows  # the window step loses nothing
    assert np.mean([w in found for w in wanted]) >= 0.95
    clean = [prose(300, 9_000 + k) for k in range(60)]
    assert items.leaks(*D.normalise(*utf8(pa.array(clean)))[:2]) == {}


def test_edit_search_is_exact():
    rng = random.Random(8)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (9, 30))
        row, best = [0] * (len(t) + 1), None
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        got = D.edit_search(p, t, len(p))
        best = min(row[1:])
        assert got[0] == best and got[1] == 1 + row[1:].index(best)


def test_leaks_awkward_rows_and_blocks(spark, monkeypatch):
    item = prose(30, 77)
    bench = [(1, item), (2, None), (3, ""), (4, "tiny"), (5, item.upper()), (6, prose(25, 78))]
    more = [(60, prose(20, 1) + "\n" + item.upper().replace(" ", "  ") + " " + prose(5, 2)), (61, "a tiny thing"), (62, item[: len(item) // 2]), (63, "x" + item)]
    df, rows = awkward(spark, more)
    items = spark.createDataFrame(bench, "item_id long, text string")
    def pairs():
        return {(r["doc_id"], r["item_id"]): (r["edits"], r["start"], r["end"]) for r in D.find_leaks(df, items).collect()}
    got = pairs()
    assert set(got) == {(60, 1), (60, 5), (61, 4), (63, 1), (63, 5)}
    edits, a, b = got[60, 1]
    assert edits == 0 and D.plain(more[0][1][a:b]) == D.plain(item)
    monkeypatch.setattr(D, "ITEM_BYTES", 100)
    assert len(D.item_blocks(items, "item_id", "text", 100)) > 1
    kept = D.remove_leaks(df, items)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if i not in (60, 61, 63))
    assert D.find_leaks(empty(spark), items).count() == 0 and D.find_leaks(df, items.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    ids = sorted(rows)
    _, failed, p = quality.verdicts(pa.array([rows[i] for i in ids]), model)
    left = {i: rows[i] for i, f, x in zip(ids, failed, p) if not f and x >= quality.THRESHOLD}
    _, top = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if top(i) == i}
    items = D.Items(duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall())
    leaks = {i for i, t in left.items() for c, k in zip(items.chars, items.edits) if D.edit_search(c, D.plain(t).decode("utf-8", "replace"), k)}
    now = docs
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, now, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == docs.columns
        if k == 1:
            assert {r["doc_id"] for r in now.collect()} == set(left)
        if k == 2:
            got = {r["doc_id"] for r in now.collect()}
            assert set(left) - leaks <= got and len(leaks & got) <= 0.05 * len(leaks)
            crf = secrets_scan.train(now)
    final = {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()}
    for i, (t, n) in final.items():
        assert n == len(t) and not secrets_scan.spans_of([t], crf, [True])[0][0]
        if not secrets_scan.spans_of([left[i]], crf, [True])[0][1]:
            assert t == left[i]
    packed = P.run(spark, SF_SMALL).collect()
    encoder = packing.Encoder()
    assert sum(r["length"] for r in packed) == sum(len(encoder.ids(t)) + 1 for t, _ in final.values())
    assert {r["doc_id"] for r in packed} == set(final)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, now, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    assert now.count() == 0 and "corpus_pipeline" in sys.modules


def test_stars_need_no_contraction(spark, monkeypatch):
    """Edges that are stars already are the components; others are contracted until they are."""
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")
    assert sorted(map(tuple, components(chain).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    monkeypatch.setattr("tripcast.llm.components._star", lambda *a: 1 / 0)
    stars = spark.createDataFrame([(1, 2), (3, 1), (9, 8), (5, 5)], "a long, b long")
    assert sorted(map(tuple, components(stars).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert components(stars.where("a = 0")).count() == 0


def test_windows_take_a_bounded_part_of_a_batch(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij ", k=9)) for _ in range(4_000)]
    texts = [" ".join(rng.choices(words, k=330)) for _ in range(800)] + ["", "x" * 700_000, None]
    items = D.Items([(i, texts[7 * i][200:420]) for i in range(60)])
    raw, bounds = utf8(pa.array(texts))
    norm, at_bounds, at = D.normalise(raw, bounds)
    tracemalloc.start()
    got = items.windows(norm, at_bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(norm)
    for size in (1, 1 << 40):
        monkeypatch.setattr(D, "SCAN_BYTES", size)
        monkeypatch.setattr(D, "GATHER_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(got, items.windows(norm, at_bounds)))
        assert {(7 * i, i) for i in range(60)} <= set(items.leaks(norm, at_bounds))
