"""Materialised, year-partitioned travel tables give the same answers and prune partitions."""

import os
import re

from pyspark.sql import functions as F

from tripcast.operators import dashboard as D
from tripcast.plans.catalog import YEARS, _f, _h, _u
from tripcast.sources import warehouse as W
from conftest import SF_SMALL


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_materialized_views_match_derived(spark, tmp_path):
    out = str(tmp_path / "wh")
    W.materialize(spark, SF_SMALL, out)
    f, h, u = W.load_flights(spark, out), W.load_hotels(spark, out), W.load_users(spark, out)
    assert _same(f.select(*_f(spark, SF_SMALL).columns), _f(spark, SF_SMALL))
    assert _same(h.select(*_h(spark, SF_SMALL).columns), _h(spark, SF_SMALL))
    assert _same(u, _u(spark, SF_SMALL))
    # a dashboard query on the pruned read equals the filter on the derived view
    pruned = D.monthly_price_by_class(W.load_flights(spark, out, YEARS))
    direct = D.monthly_price_by_class(_f(spark, SF_SMALL), YEARS)
    assert _same(pruned, direct)
    plan = W.load_flights(spark, out, YEARS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[year#\d+ IN \(1996,1998\)\]", plan)
    # unparseable dates are kept (null year partition)
    assert W.load_flights(spark, out).where("date IS NULL").count() == _f(spark, SF_SMALL).where("date IS NULL").count() > 0


def test_a_dominant_year_is_split_over_files(spark, tmp_path, monkeypatch):
    flights = _f(spark, SF_SMALL).withColumn("date", F.to_date(F.lit("1996-05-04")))
    big = flights.join(spark.range(40).withColumnRenamed("id", "copy"))
    monkeypatch.setattr(W.L, "load_flights", lambda spark, d: big)
    monkeypatch.setattr(W, "MAX_RECORDS", 20_000)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        out = str(tmp_path / "wh")
        W.materialize(spark, SF_SMALL, out)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = [f for f in os.listdir(f"{out}/flights/year=1996") if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(f"{out}/flights").count() == big.count()
