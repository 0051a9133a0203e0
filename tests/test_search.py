"""Trigram search and exact cosine joins against plain versions."""

import io
import math
import random
from contextlib import redirect_stdout
from itertools import combinations

import regex
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripcast.operators import recommend as R
from tripcast.operators import similarity as SIM
from tripcast.operators import text_index as TI
from tripcast.plans.catalog import _catalogue

LETTERS = "abcde é😀 -1"


def frame(spark, rows, name):
    return spark.createDataFrame([(x,) for x in rows], f"{name} string").repartition(3)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_search_finds_what_a_nested_loop_finds(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(150)] + [word(10_000) for _ in range(3)] + ["", None, "a", "ab", "😀😀"]
    terms = {word(rng.randrange(0, 7)) for _ in range(80)} | {t[5:5 + k] for t in texts if t and len(t) > 20 for k in (1, 2, 3, 9)} | {"", "zzz", "abz", "😀", "😀😀"}
    index = TI.build_index(frame(spark, [*texts, *texts], "text"))
    got = {(r["term"], r["text"]) for r in TI.containing(index, frame(spark, [*terms, None], "term")).collect()}
    assert got == {(x, t) for x in terms for t in texts if t is not None and x in t}
    hits = TI.containing(index, frame(spark, list(terms), "term"))
    assert "NestedLoop" not in plan(hits) and "Cartesian" not in plan(hits)
    # the index grows with the texts: at most three rows a character
    assert index.where("text = 'ab'").count() == 4 and index.count() <= 3 * sum(map(len, filter(None, texts))) + len(texts)


PATTERNS = ["", "abc", "^ab", "a.c", "a|b", "ab|cd", "(ab)+c", "ab?c", "ab*", "a{2}b", "ab+c", "[abc]d", "[^a]b", "\\d1", "\\.a", "a\\|b", "(a|b)c", "((a)b)c", "x?", "ab|",
            "|", ".*", "d(?=e)", "(?:ab|cd)e", "(?i)AB", "a\\x62", "\\u0061b", "\\p{L}b", "\\Qab\\E", "[ab[cd]]e", "[]a]b", "e{0,2}a", "ab{1,}?c", "a++b", "é😀?", "😀+", "a$", "[a-c&&[b]]d",
            "(a)\\1", "a\\\\?b", "-1", "cde|[ab]", "ab(c)?de"]


def test_regex_search_finds_what_a_nested_loop_finds(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["abc", "aab", "a|b", "a\\b", "\\b", "AB", "", "ab{c", "a.c", ".a"]
    rows, patterns = frame(spark, texts, "text"), frame(spark, PATTERNS, "pattern")
    found = TI.matching(TI.build_index(rows), patterns)
    loop = patterns.join(rows.distinct(), F.rlike("text", F.col("pattern")))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in loop.collect()}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_required_literals(spark):
    expected = {"abc": ["abc"], "^nation 1$": ["nation 1"], "ab+cde": ["cde"], "abc?": ["ab"], "a|bc": ["a", "bc"], "a|": [""], "(x|y)": [""], "par(is|ma)": ["par"],
                "\\w+ city": [" city"], "[ab]|c": [""], "(?i)abc": [""], "\\Qa.c\\E": [""], "a\\.bc": ["bc"], "x{2,3}yz": ["yz"], "\\x41bc": ["bc"], "[]ab]cd": [""]}
    got = frame(spark, expected, "p").select("p", TI.required_literals(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in got} == expected


def vectors(seed, n=60, terms=14):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        out[i] = dict(out[rng.randrange(i)]) if i and rng.random() < 0.3 else {f"t{j}": rng.choice([0.5, 1.0, 1.5, 3.0]) for j in rng.sample(range(terms), rng.randrange(1, 7))}
    return out


def plain_classes(vs):
    reps = {}
    for i in sorted(vs):
        reps.setdefault(tuple(sorted(vs[i].items())), []).append(i)
    return {m[0]: m for m in reps.values()}


def cosine(a, b):
    n = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return round(sum(x * b.get(t, 0.0) for t, x in a.items()) / n(a) / n(b), 9)


def test_cosine_join_is_exact(spark):
    for seed in range(3):
        vs = vectors(seed)
        classes = plain_classes(vs)
        long = spark.createDataFrame([(i, t, w) for i, v in vs.items() for t, w in v.items()] + [(999, "t1", 0.0), (None, "t1", 1.0)], "doc_id int, term string, weight double")
        v = SIM.vector_classes(long.repartition(5))
        assert {tuple(r) for r in v.members.collect()} == {(m, rep) for rep, ms in classes.items() for m in ms}
        every = {(a, b): cosine(vs[a], vs[b]) for a, b in combinations(sorted(classes), 2)}
        for t in (0.25, 0.7, 0.95, 1.0):
            got = {(r["item_a"], r["item_b"]): (r["cosine"], r["members_a"], r["members_b"]) for r in SIM.similar_pairs(v, t).collect()}
            assert got == {p: (c, len(classes[p[0]]), len(classes[p[1]])) for p, c in every.items() if c >= t}
        both = every | {(b, a): c for (a, b), c in every.items()}
        near = {i: sorted((-c, b) for (a, b), c in both.items() if a == i and c > 0)[:4] for i in classes}
        got = sorted(tuple(r) for r in SIM.top_neighbours(v, 4).collect())
        assert got == sorted((i, k + 1, b, -c) for i, found in near.items() for k, (c, b) in enumerate(found))


def test_prefixes_prune_pairs(spark):
    """A term that all vectors share is in no prefix at a high threshold: few pairs are met."""
    rows = [(i, t, w) for i in range(300) for t, w in ((f"own{i // 3}", 1.0), ("all", 0.3), (f"two{i % 3}", 0.2))]
    v = SIM.vector_classes(spark.createDataFrame(rows, "doc_id int, term string, weight double"))
    a = SIM._prefixes(v.terms, 0.9, "a")
    assert a.where("term = 'all'").count() == 0
    assert SIM.similar_pairs(v, 0.9).count() == 300  # three of a kind each
    none = SIM.vector_classes(spark.createDataFrame([], "doc_id int, term string, weight double"))
    assert SIM.similar_pairs(none, 0.5).count() == 0 and SIM.top_neighbours(none, 3).count() == 0


def test_regex_destinations_of_the_recommender(spark):
    cat = _catalogue(spark, SF_SMALL)
    model = R.fit(cat)
    body = "request_id int, destination string, style string, climate string, travel_type string, amenities array<string>, budget_max double, min_stars int, min_review double"
    ask = [(1, "NATION (1|2)$", None, None, None, [], None, None, None), (2, "nation", None, None, None, [], None, None, None), (3, "^x", None, None, None, [], None, None, None)]
    got = {}
    for r in R.recommend(model, spark.createDataFrame(ask, body), regex=True).collect():
        got.setdefault(r["request_id"], []).append(r["location"])
    places = {r["location"] for r in cat.collect()}
    assert set(got) == {i for i, d in ((1, "nation (1|2)$"), (2, "nation"), (3, "^x")) if any(regex.search(d, p.lower()) for p in places)}
    assert all(regex.search("nation (1|2)$", p.lower()) for p in got.get(1, []))


def large_catalogue(spark, n, seed=5):
    rng = random.Random(seed)
    styles = ["luxury", "boutique", "business", "budget / backpacker"]
    rows = []
    for i in range(n):
        t = rng.random()
        rows.append((i, f"hotel {i}", f"nation {rng.randrange(6)}", "Brazil", rng.choice(styles), rng.choice(["coastal", "tropical"]), rng.choice([3, 4, 5]),
                     round(40 + 900 * t, 2) if i % 50 else 500.0, round(6.5 + 3 * rng.random(), 1), rng.choice(["wifi pool", "wifi spa gym", "bar", "spa"]), "leisure", 1))
    return spark.createDataFrame(rows, "price_rank int, name string, location string, country string, style string, climate string, star_rating int, "
                                 "avg_price_per_night double, review_score double, amenities string, travel_type string, bookings long")


def test_bounded_top_k_gives_the_same_rows_and_opens_few_hotels(spark):
    model = R.fit(large_catalogue(spark, 4000))
    rng = random.Random(6)
    body = "request_id int, destination string, style string, climate string, travel_type string, amenities array<string>, budget_max double, min_stars int, min_review double"
    asks = [(i, rng.choice(["nation 1", "nation", "", None, "brazil", "Paris", " NATION 3 "]), rng.choice([None, "luxury", "business"]), rng.choice([None, "coastal"]), None,
             rng.choice([[], ["wifi", "spa"], None]), rng.choice([None, 0.0, 41.0, 300.0, 555.5, 5000.0]), rng.choice([None, 0, 4, 5]), rng.choice([None, 0.0, 7.05, 9.4, 9.9]))
            for i in range(60)]
    requests = spark.createDataFrame(asks, body)
    for top_n in (1, 5, 40):
        plain = {tuple(r) for r in R.recommend(model, requests, top_n).collect()}
        assert {tuple(r) for r in R.recommend(model, requests, top_n, bounded=True).collect()} == plain
    # one wide-open request: a small part of the catalogue is opened
    items = R.hotel_blocks(model.items.withColumns({"_loc": F.lower("location"), "_cty": F.lower("country")}))
    one = spark.createDataFrame([("p", 400.0, 4, 8.0)], "profile string, budget_max double, min_stars int, min_review double")
    one = one.crossJoin(items.select("_loc", "_cty").distinct()).withColumn("qvec", F.lit(None).cast("map<string,double>"))
    opened = R.reachable(model, one, items, 5).join(items, ["_loc", "_cty", "_sign", "_cell"]).count()
    assert 5 <= opened <= 400
