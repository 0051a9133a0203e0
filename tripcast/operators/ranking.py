"""Global ordinal positions without funnelling rows through one task.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into a
single task. Here the rows are cut into buckets of the order: a bounded sample
of the keys (the rows with the smallest key hashes, so the same on any
partitioning) gives the boundaries, and a row's bucket is a pure column
expression over them. Positions inside a bucket and the counts before it
therefore belong to the same buckets however the two are executed. The result
is exact and deterministic when the order keys are a total order (include a
unique key as the last one); the sample only decides how even the buckets are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampled keys for each boundary. The sample is bounded by this times the bucket count.
SAMPLE_PER_BUCKET = 20


def _boundaries(keys: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 boundaries: evenly spaced keys of a sorted, bounded sample."""
    cols = keys.columns
    sample = keys.orderBy(F.xxhash64(*cols), *cols).limit(n * SAMPLE_PER_BUCKET)
    rows = [tuple(r) for r in sample.distinct().orderBy(*cols).collect()]
    cuts = [rows[i * len(rows) // n] for i in range(1, n)] if rows else []
    return list(dict.fromkeys(cuts))


def _bucket(key: Column, cuts: list[Column]) -> Column:
    """Number of boundaries at or below ``key``, by a binary search written as nested conditions."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_idx",
                      total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Adds a 0-based position ``name`` in ascending order, nulls first (and optionally the row count ``total``)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_k{i}" for i in range(len(cols))]
    keys = df.select(*[c.alias(k) for c, k in zip(cols, names)])
    types = [f.dataType for f in keys.schema.fields]
    cuts = [F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(row, types, names)]) for row in _boundaries(keys, n)]
    bucket = _bucket(F.struct(*[c.alias(k) for c, k in zip(cols, names)]), cuts)
    counts = df.select(bucket.alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_b").orderBy(*cols)
    # ``offsets`` has at most one row per bucket: a proven broadcast bound.
    out = (df.withColumn("_b", bucket).withColumn("_pos", F.row_number().over(inside) - 1)
           .join(F.broadcast(offsets), "_b").withColumn(name, F.col("_off") + F.col("_pos")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_b", "_pos", "_off", "_total")


def rank_within(df: DataFrame, group: str, order: Sequence[str | Column], name: str = "rank_in_group",
                size: str = "group_size") -> DataFrame:
    """0-based position inside ``group`` under ``order`` without one task per group.

    A hot group (a third of all rows) is spread over many buckets, because the
    global order (group, order...) is cut by value, not by group. Group sizes
    and starting offsets come from a per-group count, one row per group: meant
    for class-like groups (labels, strata). Spark joins them by their size at
    run time. Rows without a group are left out.
    """
    known = df.where(F.col(group).isNotNull())
    g = global_row_number(known, [group, *order], "_g")
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias(size))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return (g.join(starts, group)
            .withColumn(name, F.col("_g") - F.col("_start")).drop("_g", "_start"))
