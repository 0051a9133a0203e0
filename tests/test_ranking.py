"""The distributed global ranking equals the single-task window, including on a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripcast.operators.ranking import global_row_number, rank_within
from tripcast.operators import sampling as S


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    got = global_row_number(df, ["v", "id"], "r", total="n").select("id", "r", "n")
    exp = df.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("r"))
    assert got.join(exp, ["id", "r"]).count() == 5000
    assert {r["n"] for r in got.select("n").distinct().collect()} == {5000}


def test_rank_within_hot_group(spark):
    # one group holds 1/3 of all rows
    df = spark.range(0, 6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("g"))
    got = rank_within(df, "g", ["id"], "r", "n")
    exp = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("r"))
    assert got.join(exp, ["id", "r"]).count() == 6000


def test_stratified_split_counts(spark):
    df = spark.range(0, 1003).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y"))
    tr, te = S.stratified_split(df, "id", "y")
    counts = {r["y"]: r["count"] for r in te.groupBy("y").count().collect()}
    assert counts == {"a": S.test_count(251), "b": S.test_count(752)}
    assert tr.count() + te.count() == 1003


def test_hash_split_is_stable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = [r[0] for r in S.train_test_split(df.repartition(7), "k")[1].orderBy("k").collect()]
    b = [r[0] for r in S.train_test_split(df.repartition(3), "k")[1].orderBy("k").collect()]
    assert a == b and 300 < len(a) < 500


def test_fixed_sample_size(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    assert S.fixed_sample(df, "k", 30).count() == 30
    assert S.fixed_sample(df, "k", 300).count() == 100


def test_fixed_sample_equals_plain_top_n(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    h = S.seeded_hash("k")
    for n in (1, 2, 7, 500):  # small n exercises the threshold-doubling loop
        got = [r["k"] for r in S.fixed_sample(df, "k", n).collect()]
        exp = [r["k"] for r in df.withColumn("_h", h).orderBy("_h", "k").limit(n).collect()]
        assert sorted(got) == sorted(exp) and len(got) == n


@pytest.mark.parametrize("parts", [2, 4, 16, 200])
def test_ranks_with_payload_columns(spark, parts):
    # wide rows, more than Spark's range sample, and any number of shuffle partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(0, 100_000, 1, 7).select(
            "id", (F.col("id") * 7919 % 10_007).alias("v"), F.md5(F.col("id").cast("string")).alias("payload"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"))
        got = global_row_number(df, ["v", "id"], "r").select("id", "payload", "r")
        exp = df.select("id", "payload", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("r"))
        assert got.join(exp, ["id", "payload", "r"]).count() == 100_000
        got = rank_within(df, "g", ["v", "id"], "r", "n").select("id", "payload", "r")
        exp = df.select("id", "payload", (F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1).alias("r"))
        assert got.join(exp, ["id", "payload", "r"]).count() == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [2, 16])
def test_stratified_split_has_no_leak(spark, tmp_path, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(0, 100_003, 1, 9).select(
            "id", F.md5(F.col("id").cast("string")).alias("payload"),
            F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("y"))
        tr, te = S.stratified_split(df, "id", "y")
        tr.write.parquet(str(tmp_path / "train"))
        te.write.parquet(str(tmp_path / "test"))
        tr, te = spark.read.parquet(str(tmp_path / "train")), spark.read.parquet(str(tmp_path / "test"))
        assert tr.join(te, "id").count() == 0 and tr.count() + te.count() == 100_003
        sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
        assert {r["y"]: r["count"] for r in te.groupBy("y").count().collect()} == {y: S.test_count(n) for y, n in sizes.items()}
        h = S.seeded_hash("id")
        exp = df.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(h, "id")))
        worst = exp.join(te.select("id"), "id").groupBy("y").agg(F.max("r").alias("r"))
        assert {r["y"]: r["r"] for r in worst.collect()} == {y: S.test_count(n) for y, n in sizes.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_with_null_keys_and_empty_input(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id long, v string")
    got = {r["id"]: r["r"] for r in global_row_number(df, ["v", "id"], "r").collect()}
    assert got == {1: 0, 4: 1, 3: 2, 2: 3}
    assert global_row_number(df.where("id > 9"), ["v", "id"], "r").count() == 0
