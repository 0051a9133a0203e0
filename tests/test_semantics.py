"""Literal-frame tests for the decided semantics."""

import pytest
from pyspark.sql import functions as F

from tripcast.functions import columns as C
from tripcast.functions import features as FE
from tripcast.operators import dashboard as D
from tripcast.sources import loaders as L
from tripcast.sources import schemas


def test_s1_half_even_inr(spark):
    df = spark.createDataFrame([(0.5 / 83,), (2.5,), (1.0,)], "usd double")
    got = [r[0] for r in df.select(F.bround(F.col("usd") * 83.0, 0)).collect()]
    assert got[1] == 208.0 and got[2] == 83.0  # 207.5 -> 208 (even), 83 exact
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(F.bround("x", 0)).collect()] == [2.0, 4.0]


def test_s2_null_keys_dropped(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    out = {r["k"]: r["bookings"] for r in D.value_counts(df, "k").collect()}
    assert out == {"a": 2}


def test_s3_city_fallback(spark):
    df = spark.createDataFrame([("Sao Paulo (SP)",), ("Nowhere",), (None,)], "p string")
    got = [tuple(r) for r in df.select(C.city_of("p"), C.state_of("p")).collect()]
    assert got == [("Sao Paulo", "SP"), ("Nowhere", None), (None, None)]


def test_s4_lenient_and_strict_dates(spark):
    df = spark.createDataFrame([("09/06/2019",), ("9/6/2019",), ("bad-date",)], "d string")
    got = [r[0] for r in df.select(C.parse_date_lenient("d")).collect()]
    assert str(got[0]) == "2019-09-06" and str(got[1]) == "2019-09-06" and got[2] is None
    with pytest.raises(Exception):
        df.select(C.parse_date_strict("d")).collect()


def test_s5_age_bands_left_closed(spark):
    df = spark.createDataFrame([(17,), (18,), (24,), (25,), (64,), (65,), (99,), (100,), (None,)], "age int")
    got = [r[0] for r in df.select(C.age_band("age")).collect()]
    assert got == [None, "18–24", "18–24", "25–34", "55–64", "65+", "65+", None, None]


def test_s8_minmax_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    b = FE.fit_minmax(df, ["x"])
    assert [r[0] for r in df.select(FE.minmax("x", *b["x"])).collect()] == [0.0, 0.0]
    # ideal point outside the fitted range is not clipped
    assert spark.range(1).select(FE.minmax(F.lit(7.0), *b["x"])).first()[0] == 2.0


def test_s11_exact_median_and_s12_population_std(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert FE.fit_medians(df, ["x"])["x"] == 2.5
    m, s = FE.fit_standard(spark.createDataFrame([(1,), (2,), (3,)], "x int"), ["x"])["x"]
    assert m == 2.0 and abs(s - (2 / 3) ** 0.5) < 1e-12


def test_fea2_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert FE.fit_modes(df, ["c"])["c"] == "a"


def test_s17_divide_by_zero_is_null(spark):
    row = spark.range(1).select(F.try_divide(F.lit(1.0), F.lit(0.0))).first()
    assert row[0] is None


def test_s18_json_empty_vs_malformed(spark):
    df = spark.createDataFrame([("{}",), ("not json",), ('{"from": "A", "to": "A", "flightType": "x", "agency": "y"}',)], "body string")
    from tripcast.streaming.scoring import route_requests
    got = [(r["status"], r["message"]) for r in route_requests(df).collect()]
    assert got == [("error", "No input data provided"), ("error", "Invalid JSON payload"),
                   ("rejected", "Origin and destination must differ")]


def test_prj_name_forms(spark):
    df = spark.createDataFrame([("ana Maria",), ("  Bo  ",), (None,), ("",)], "name string")
    tr = df.select(*[v.alias(k) for k, v in C.name_features_training("name").items()]).collect()
    assert tuple(tr[0]) == ("ana", 3, "a", "a")
    assert tuple(tr[2]) == (None, None, None, None)
    sv = df.select(*[v.alias(k) for k, v in C.name_features_serving("name").items()]).collect()
    assert tuple(sv[1]) == ("Bo", 2, "B", "o")
    codes = df.select(*[v.alias(k) for k, v in C.name_codes("name").items()]).collect()
    assert tuple(codes[0]) == (3, 0, 0) and tuple(codes[2]) == (0, 0, 0) and tuple(codes[3]) == (0, 0, 0)


def test_prj_formats_and_labels(spark):
    df = spark.createDataFrame([(500.0,)], "usd double")
    assert df.select(C.fmt_inr("usd")).first()[0] == "₹41,500"
    arr = spark.createDataFrame([(["fine_dining", "wifi"],)], "a array<string>")
    labels = arr.select(C.amenity_labels("a").alias("l")).first()["l"]
    assert labels == ["Fine Dining", "Wifi"]
    back = arr.select(C.amenity_tokens(C.amenity_labels("a"))).first()[0]
    assert back == ["fine_dining", "wifi"]
    assert spark.range(1).select(C.route_label(F.lit("A"), F.lit("B"))).first()[0] == "A → B"
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.7,), (0.1,)], "c double").select(C.confidence_band("c")).collect()] \
        == ["high", "moderate", "low"]


def test_flt_empty_selection_is_no_filter(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, flightType string").withColumn("date", F.lit(None).cast("date"))
    assert D.filter_years(df, []).count() == 2
    assert D.filter_years(df, [2020]).count() == 0  # null dates fail a non-empty filter
    assert D.filter_classes(df, ["x"]).count() == 1


def test_drop_ids_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2, 3)], "travelCode long, userCode long, price long")
    assert C.drop_ids(df, ["travelCode", "userCode", "nope"]).columns == ["price"]


def test_optional_source_missing_is_none(spark, tmp_path):
    assert L.load_optional(spark, str(tmp_path / "missing.csv"), schemas.FLIGHTS) is None
    p = tmp_path / "f.csv"
    p.write_text("travelCode,userCode,from,to,flightType,price,time,distance,agency,date\n"
                 "1,2,A (AA),B (BB),economic,10.5,1.0,100.0,Rainbow,01/02/2020\n"
                 "x,2,A,B,economic,notanumber,1,1,R,01/02/2020\n")
    df = L.load_optional(spark, str(p), schemas.FLIGHTS)
    rows = df.collect()
    assert len(rows) == 2 and rows[0]["_corrupt_record"] is None and rows[1]["_corrupt_record"] is not None


def test_fallback_catalogue(spark):
    assert L.fallback_catalogue(spark).count() == 5


def test_fea1_approximate_median_option(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "x")
    assert FE.fit_medians(df, ["x"])["x"] == 500.0
    assert abs(FE.fit_medians(df, ["x"], approx=True)["x"] - 500.0) <= 1.0


def test_materialize_and_literal_frame(spark):
    from tripcast.session import literal_frame, materialize
    df = spark.range(0, 1000).withColumn("y", F.col("id") % 7).groupBy("y").count()
    m = materialize(df)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect()))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan  # lineage cut: reads the written table
    lit = literal_frame(spark, [("a", 1), ("b", 2)], ["k", "v"])
    assert [tuple(r) for r in lit.collect()] == [("a", 1), ("b", 2)]
    assert "PythonRDD" not in lit._jdf.queryExecution().executedPlan().toString()
