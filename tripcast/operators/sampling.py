"""Deterministic sampling and splits (SMP family) and balanced class weights (MDL7).

A seeded permutation is replaced by the md5 of ``'<seed>|<key>'``: the same
value on any partitioning, any executor, after any retry, and in DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
TEST_FRACTION = 0.2


def seeded_hash(key: str | Column, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


# SMP1 / SMP2 — fixed-size sample: the n rows with the smallest hashes.
# A plain orderBy().limit(n) sends up to n rows from every input partition to
# one final task. Instead the hash prefix (uniform over [0, 16^8)) is cut at a
# threshold chosen from the row count so that about 1.1 n candidates pass; the
# threshold is doubled until at least n pass, then the exact n smallest are
# taken from the candidates only. Same rows as the plain form.
def fixed_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    h = df.withColumn("_h", seeded_hash(key, seed))
    total = df.count()
    if total > n:
        prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
        cut = min(16 ** 8, int(16 ** 8 * n / total * 1.1) + 1)
        while True:
            cand = h.where(prefix < F.lit(cut))
            if cut >= 16 ** 8 or cand.count() >= n:
                h = cand
                break
            cut = min(16 ** 8, cut * 2)
    return h.orderBy("_h", key).limit(n).drop("_h")


# SMP3 — hash split: first 8 hex digits below 0.2 * 16^8 -> test
def _threshold(fraction: float) -> str:
    return format(int(fraction * 16 ** 8), "08x")


def hash_split_flag(key: str, fraction: float = TEST_FRACTION, seed: int = SEED) -> Column:
    return F.substring(seeded_hash(key, seed), 1, 8) < F.lit(_threshold(fraction))


def train_test_split(df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: int = SEED):
    flag = hash_split_flag(key, fraction, seed)
    return df.where(~flag), df.where(flag)


# SMP4 — stratified: per label the ceil(fraction * n_label) smallest hashes are test.
# Counts by (label, hash prefix) tell in which prefix cell a label's last test row
# lies and how many of the cell are test rows; only that cell's rows (one in
# 65,536 of a label) are ranked. The flag is then a comparison with one threshold
# per label: no raw row is ranked or moved.
def stratified_flag(df: DataFrame, key: str, label: str, fraction: float = TEST_FRACTION,
                    seed: int = SEED) -> DataFrame:
    hashed = df.where(F.col(label).isNotNull()).withColumn("_h", seeded_hash(key, seed))
    cell = F.substring("_h", 1, 4)
    cells = hashed.groupBy(label, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_cell")
    cells = cells.withColumns({
        "_before": F.coalesce(F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_k": F.ceil(F.sum("_n").over(Window.partitionBy(label)) * F.lit(fraction)),
    })
    last = cells.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n"))) \
        .select(F.col(label).alias("_label"), F.col("_cell"), (F.col("_k") - F.col("_before")).alias("_need"))
    near = hashed.select(F.col(label).alias("_label"), cell.alias("_cell"), "_h", F.col(key).alias("_key")).join(last, ["_label", "_cell"])
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key")))
    limits = ranked.where(F.col("_r") == F.col("_need")).select(F.col("_label").alias(label), F.struct("_h", "_key").alias("_limit"))
    flag = F.coalesce(F.struct(F.col("_h"), F.col(key).alias("_key")) <= F.col("_limit"), F.lit(False))
    return hashed.join(limits, label, "left").withColumn("is_test", flag).select(*df.columns, "is_test")


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = TEST_FRACTION, seed: int = SEED):
    flagged = stratified_flag(df.where(F.col(label).isNotNull()), key, label, fraction, seed)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


# MDL7 — balanced weights n / (k * n_c), one row per class
def class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy()  # over the class rows only
    return counts.withColumn(name, F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c")))


def test_count(n: int, fraction: float = TEST_FRACTION) -> int:
    return math.ceil(n * fraction)
