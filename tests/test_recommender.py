"""Recommender scenarios (the source's payloads on derived cities) and a brute-force cross-check."""

import math

import regex
from pyspark.sql import functions as F

from tripcast.operators import recommend as R
from tripcast.plans.catalog import _catalogue
from tripcast.sources import schemas
from conftest import SF_SMALL

PAYLOADS = {  # FIXTURES.md §2 with fixture cities
    "A": ("NATION 1", "any", None, None, [], 1000.0, 0, 0.0),
    "B": ("NATION 1", "business", None, None, ["wifi"], 300.0, 3, 7.0),
    "C": ("NATION 7", "any", None, None, [], 1000.0, 0, 0.0),
    "D": ("NATION 2", "budget", None, None, [], 250.0, 2, 6.0),
    "E": ("NATION 1", "business", None, None, ["wifi", "gym"], 200.0, 4, 8.0),
    "F": (None, "luxury", "coastal", "leisure", ["pool", "wifi"], 350.0, 3, 7.5),
    "partial": ("Paris", None, None, None, None, 500.0, None, None),
    "empty": (None, None, None, None, None, None, None, None),
}


def _requests(spark):
    rows = [(i,) + p for i, p in enumerate(PAYLOADS.values())]
    schema = "request_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.HOTEL_REQUEST.fields)
    return spark.createDataFrame(rows, schema)


def _run(spark):
    cat = _catalogue(spark, SF_SMALL)
    model = R.fit(cat)
    return cat, model, R.recommend(model, _requests(spark))


def test_scenarios_non_empty_and_distinct(spark):
    cat, model, recs = _run(spark)
    by = {}
    for r in recs.collect():
        by.setdefault(r["request_id"], []).append(r)
    names = list(PAYLOADS)
    for i, key in enumerate(names):
        if key == "partial":
            assert i not in by  # Paris: no survivors -> no rows
        elif key in ("A", "C", "F", "empty"):
            assert 1 <= len(by[i]) <= 5
    ev = R.distinct_result_sets(recs).first()
    assert not ev["all_same"]
    # ranks are 1..k and match scores lie in [60, 95] or equal 75
    for rows in by.values():
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
        assert all(60.0 <= r["match_score"] <= 95.0 for r in rows)


TOKEN = regex.compile(r"[\p{L}\p{N}_]{2,}")


def _brute_force(cat_rows, payload, top_n=5):
    """Independent row-by-row implementation of the scoring rules."""
    docs = [" ".join(x or "" for x in (h["amenities"], h["style"], h["climate"], h["travel_type"])) for h in cat_rows]
    toks = [TOKEN.findall(d.lower()) for d in docs]
    cf, df = {}, {}
    for t in toks:
        for w in t:
            cf[w] = cf.get(w, 0) + 1
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    vocab = sorted(cf, key=lambda w: (-cf[w], w))[:500]
    n = len(cat_rows)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocab}

    def vec(words):
        tf = {}
        for w in words:
            if w in idf:
                tf[w] = tf.get(w, 0) + 1
        v = {w: c * idf[w] for w, c in tf.items()}
        nrm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / nrm for w, x in v.items()} if nrm else {}

    ivec = [vec(t) for t in toks]
    cols = ["avg_price_per_night", "star_rating", "review_score"]
    lo = {c: min(float(h[c] or 0) for h in cat_rows) for c in cols}
    hi = {c: max(float(h[c] or 0) for h in cat_rows) for c in cols}
    sc = lambda c, x: (x - lo[c]) / ((hi[c] - lo[c]) or 1.0)
    dest, style, climate, travel, amen, budget, stars, review = payload
    keep = []
    for i, h in enumerate(cat_rows):
        if budget and h["avg_price_per_night"] > budget:
            continue
        if stars and h["star_rating"] < stars:
            continue
        if review and h["review_score"] < review:
            continue
        if dest and dest.strip():
            d = dest.strip().lower()
            if d not in h["location"].lower() and d not in h["country"].lower():
                continue
        keep.append(i)
    if not keep:
        return []
    q = (" ".join(amen or []) + " " + (style or "") + " " + (climate or "") + " " + (travel or "")).strip() or "hotel"
    qv = vec(TOKEN.findall(q.lower()))
    mx = max(cat_rows[i]["avg_price_per_night"] for i in keep)
    ideal = [min(budget if budget is not None else mx, mx), 4 if stars is None else stars, 8.0 if review is None else review]
    out = []
    for i in keep:
        h = cat_rows[i]
        text = sum(w * ivec[i].get(t, 0.0) for t, w in qv.items())
        dist = math.sqrt(sum((sc(c, float(h[c] or 0)) - sc(c, float(x))) ** 2 for c, x in zip(cols, ideal)))
        out.append((round(0.6 * text + 0.4 / (1 + dist), 9), h["price_rank"], h["name"]))
    out.sort(key=lambda t: (-t[0], t[1]))
    return [name for _, _, name in out[:top_n]]


def test_matches_brute_force(spark):
    cat, model, recs = _run(spark)
    cat_rows = sorted(cat.collect(), key=lambda r: r["price_rank"])
    got = {}
    for r in recs.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["name"])
    for i, p in enumerate(PAYLOADS.values()):
        assert got.get(i, []) == _brute_force(cat_rows, p), list(PAYLOADS)[i]


def test_unknown_destination_note(spark):
    cat = _catalogue(spark, SF_SMALL)
    notes = R.unknown_destinations(_requests(spark), cat).collect()
    assert {r["destination"] for r in notes} == {"Paris"}


def test_save_load_same_results(spark, tmp_path):
    cat, model, recs = _run(spark)
    R.save(model, str(tmp_path / "m"))
    back = R.load(spark, str(tmp_path / "m"))
    again = R.recommend(back, _requests(spark))
    assert recs.exceptAll(again).count() == 0 and again.exceptAll(recs).count() == 0


def test_many_blank_destinations_and_repeated_profiles(spark):
    """One plan at every size: requests without a destination see all hotels, equal requests get equal rows."""
    cat, model, _ = _run(spark)
    reqs = spark.range(0, 3000).select(
        F.col("id").alias("request_id"), F.lit(None).cast("string").alias("destination"), F.lit("luxury").alias("style"),
        F.lit(None).cast("string").alias("climate"), F.lit(None).cast("string").alias("travel_type"),
        F.array(F.lit("pool")).alias("amenities"), (F.col("id") % 3 * 400.0 + 200).alias("budget_max"),
        F.lit(0).alias("min_stars"), F.lit(0.0).alias("min_review"))
    got = R.recommend(model, reqs)
    per = got.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("x"))
    assert per.groupBy((F.col("request_id") % 3).alias("b")).agg(F.count_distinct("x").alias("n")).where("n > 1").count() == 0
    rows = sorted(cat.collect(), key=lambda r: r["price_rank"])
    first = {r["request_id"]: [x["name"] for x in r["x"]] for r in per.where("request_id < 3").collect()}
    for i in range(3):
        assert first.get(i, []) == _brute_force(rows, (None, "luxury", None, None, ["pool"], i * 400.0 + 200, 0, 0.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_regex_destination_mode(spark):
    cat, model, _ = _run(spark)
    reqs = spark.createDataFrame([(1, "nation 1$", None, None, None, [], 1000.0, 0, 0.0)],
                                 "request_id int, destination string, style string, climate string, travel_type string, "
                                 "amenities array<string>, budget_max double, min_stars int, min_review double")
    literal = R.recommend(model, reqs)              # 'nation 1$' as text matches nothing
    regex = R.recommend(model, reqs, regex=True)    # as a pattern it matches exactly NATION 1
    assert literal.count() == 0
    assert {r["location"] for r in regex.collect()} == {"NATION 1"}


def test_requests_are_derived_once(spark):
    """Whatever stands behind the requests is computed once, however often the scoring uses them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    _, model, _ = _run(spark)
    plain = _requests(spark)
    got = R.recommend(model, plain.withColumn("budget_max", watched("budget_max")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.recommend(model, plain).collect()))
    assert seen.value == plain.count()
