"""Co-partitioned tables: the join equals the plain one, moves nothing, and spreads hot users."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripcast.operators import dashboard as D
from tripcast.plans.catalog import _f, _h, _u
from tripcast.sources import colocated as CL
from conftest import SF_SMALL


def _rows(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("view, plain", [(_f, D.flights_with_users), (_h, D.hotels_with_users)])
def test_join_equals_the_plain_one_without_exchange(spark, tmp_path, view, plain):
    stored = CL.store(view(spark, SF_SMALL), _u(spark, SF_SMALL), str(tmp_path), f"t_{view.__name__}", buckets=4)
    got, want = CL.with_users(spark, stored), plain(view(spark, SF_SMALL), _u(spark, SF_SMALL))
    assert got.columns == want.columns or sorted(got.columns) == sorted(want.columns)
    assert "SortMergeJoin" in _plan(got) and "Exchange" not in _plan(got)
    assert _rows(got) == _rows(want)
    # another session finds the same files
    spark.sql(f"DROP TABLE {stored.bookings}")
    spark.sql(f"DROP TABLE {stored.users}")
    CL.attach(spark, stored)
    again = CL.with_users(spark, stored)
    assert "Exchange" not in _plan(again) and _rows(again) == _rows(want)


def test_hot_null_unknown_and_repeated_users(spark, tmp_path):
    n = 3000
    bookings = spark.range(n).select(
        F.col("id").alias("travelCode"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).when(F.col("id") % 10 == 2, 99).otherwise(F.col("id") % 40).cast("long").alias("userCode"),
        F.lit("x").alias("name"))
    users = spark.range(30).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("u"), "id").alias("name"), F.lit("f").alias("gender"))
    users = users.union(users.where("code = 5"))
    hot = {r["userCode"]: r["slots"] for r in CL.hot_users(bookings, 8).collect()}
    assert set(hot) >= {7} and len(hot) < 8 and sum(hot.values()) < 16 and hot[7] >= 3
    stored = CL.store(bookings, users, str(tmp_path), "t_hot", buckets=8)
    assert _rows(CL.with_users(spark, stored)) == _rows(D.flights_with_users(bookings, users))
    per_bucket = spark.table(stored.bookings).groupBy("userCode", "user_slot").count()
    assert per_bucket.agg(F.max("count")).first()[0] <= 1.5 * n / 8
    empty = CL.store(bookings.limit(0), users.limit(0), str(tmp_path), "t_none", buckets=2)
    assert CL.with_users(spark, empty).count() == 0
