"""One availableNow streaming run equals the batch result (SCR4 routing, SCR1 scoring)."""

from pyspark.sql import functions as F

from tripcast.operators import ml as ML
from tripcast.plans import catalog as Q
from tripcast.streaming import scoring as SC
from conftest import SF_SMALL

SCHEMA = "request_id long, body string, source string"


def test_stream_equals_batch(spark, tmp_path):
    bodies = Q._request_bodies(spark, SF_SMALL)
    src = str(tmp_path / "in")
    bodies.repartition(4).write.json(src)
    tr, _ = Q._flight_frames(spark, SF_SMALL)
    model = ML.Pipeline(stages=ML.build_preprocessor(tr, Q.FLIGHT_COLS) + [ML.linear_regression()]).fit(tr)

    def transform(df):
        routed = SC.route_requests(df)
        scored = SC.score_prices(model, routed.where(F.col("status") == "valid").select("request_id", "req.*"))
        return scored.select("request_id", "predicted_price")

    SC.run_stream(spark, transform, spark.read.schema(SCHEMA).json(src).schema, src, str(tmp_path / "out"),
                  str(tmp_path / "ck"))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = transform(spark.read.schema(SCHEMA).json(src))
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0

    routed = SC.route_requests(spark.read.schema(SCHEMA).json(src))
    assert routed.where("status = 'error'").count() > 0  # malformed bodies and event payloads are kept, not raised


def test_recommendation_stream_equals_batch(spark, tmp_path):
    """SCR3 streaming form: foreachBatch runs the batch recommender per micro-batch."""
    from tripcast.operators import recommend as R
    from tripcast.sources import fixtures as FX

    model = R.fit(Q._catalogue(spark, SF_SMALL))
    reqs = FX.hotel_requests(Q._f(spark, SF_SMALL))
    src = str(tmp_path / "req")
    reqs.repartition(3).write.json(src)
    schema = spark.read.schema("request_id long, destination string, style string, climate string, "
                               "travel_type string, amenities array<string>, budget_max double, "
                               "min_stars int, min_review double").json(src).schema
    SC.run_stream_batches(spark, lambda b: R.recommend(model, b), schema, src,
                          str(tmp_path / "out"), str(tmp_path / "ck"))
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    batch = R.recommend(model, spark.read.schema(schema).json(src))
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_replayed_epoch_leaves_no_duplicates(spark, tmp_path):
    """A micro-batch that runs again (its commit was lost) replaces its own output."""
    import os

    bodies = Q._request_bodies(spark, SF_SMALL)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    bodies.limit(200).write.json(src)
    schema = spark.read.schema(SCHEMA).json(src).schema
    SC.run_stream_batches(spark, lambda b: b.select("request_id"), schema, src, out, ck)
    first = spark.read.parquet(out).count()
    for f in os.listdir(f"{ck}/commits"):
        os.remove(f"{ck}/commits/{f}")  # the epoch was written, its commit was not
    SC.run_stream_batches(spark, lambda b: b.select("request_id"), schema, src, out, ck)
    assert spark.read.parquet(out).count() == first == 200


def test_hotel_requests_are_answered(spark):
    """Malformed and empty bodies are errors, a place without hotels has no match, the others are answered in full."""
    from tripcast.operators import recommend as R

    model = R.fit(Q._catalogue(spark, SF_SMALL))
    rows = [(1, "not json"), (2, "{}"), (3, '{"destination": "Paris", "budget_max": 500}'), (4, '{"destination": "NATION 1", "style": "any", "budget_max": 1000}'),
            (5, None), (6, '{"min_stars": 3}')]
    routed = SC.route_hotel_requests(spark.createDataFrame(rows, "request_id long, body string"))
    got = {r["request_id"]: r for r in SC.recommendation_responses(routed, lambda q: R.recommend(model, q)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "error", 2: "error", 3: "no_match", 4: "success", 5: "error", 6: "success"}
    assert got[1]["message"] == "Invalid JSON payload" and got[2]["message"] == "No input data provided"
    assert [x["rank"] for x in got[6]["recommendations"]] == [1, 2, 3, 4, 5] and got[6]["model_version"] == SC.MODEL_VERSION
    assert got[4]["input_received"]["destination"] == "NATION 1" and got[2]["recommendations"] is None


def test_default_cities_stand_in_for_empty_views(spark):
    from tripcast.operators import dashboard as D

    f, h = Q._f(spark, SF_SMALL), Q._h(spark, SF_SMALL)
    assert [r["city"] for r in D.unique_cities(f.limit(0), h.limit(0)).collect()] == sorted(D.DEFAULT_CITIES)
    assert not set(D.DEFAULT_CITIES) & {r["city"] for r in D.unique_cities(f, h).collect()}


def test_fallback_answers_valid_requests_only(spark):
    got = Q.QUERIES["SCR5_fallback_scoring"](spark, SF_SMALL)
    counts = {(r["status"], r["source"]): r["n"] for r in got.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(counts) == {("success", "primary"), ("success", "fallback"), ("rejected", None), ("error", None)}
    assert got.where("status <> 'success' and (price_ok is not null or model_version is not null)").count() == 0
    assert got.where("status = 'success' and not price_ok").count() == 0


def _deliver(spark, rows, src):
    (spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(src))


def test_a_request_delivered_twice_is_answered_once(spark, tmp_path):
    """Within one delivery, in a later micro-batch, after a restart and after a lost commit."""
    import os

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        SC.run_stream(spark, lambda s: SC.route_requests(SC.once(s)).select("source", "request_id", "body", "status"),
                      spark.createDataFrame([], SCHEMA).schema, src, out, ck)
        return sorted(map(tuple, spark.read.parquet(out).select("source", "request_id", "body").collect()), key=str)

    first = [(1, "{}", "a"), (1, "{}", "a"), (1, "{}", "b"), (None, "no id", "a"), (None, "no id", "a"), (None, None, "a"), (2, None, None)]
    _deliver(spark, first, src)
    want = [("a", 1, "{}"), ("a", None, "no id"), ("a", None, None), ("b", 1, "{}"), (None, 2, None)]
    assert run() == sorted(want, key=str)
    _deliver(spark, first + [(3, "{}", "a"), (None, "another", "a")], src)
    want += [("a", 3, "{}"), ("a", None, "another")]
    assert run() == sorted(want, key=str)
    last = max(int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit())
    os.remove(f"{ck}/commits/.{last}.crc")
    os.remove(f"{ck}/commits/{last}")  # the micro-batch was written, its commit was not
    _deliver(spark, [(3, "{}", "a"), (4, "{}", "a")], src)
    want += [("a", 4, "{}")]
    assert run() == sorted(want, key=str)


def test_once_in_a_batch(spark):
    rows = [(1, "b", "s"), (1, "a", "s"), (1, "a", "t"), (None, "x", "s"), (None, "x", "s"), (None, None, "s")]
    got = SC.once(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["request_id", "body", "source"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "s"), (1, "b", "s"), (1, "a", "t"), (None, "x", "s"), (None, None, "s")], key=str)
    assert SC.once(spark.createDataFrame([(None, "x"), (None, "x")], "request_id long, body string")).count() == 1
    assert SC.once(spark.createDataFrame([], SCHEMA)).count() == 0
