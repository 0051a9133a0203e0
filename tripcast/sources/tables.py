"""Access to the driver's parquet tables.

Reads are lazy and column selection happens right after the scan, so the
parquet reader only materialises the columns a query needs (``ReadSchema``)
and filters written later are pushed into it (``PushedFilters``).

``by_key`` deals rows out by a key before heavy per-row work (JSON parsing and
model scoring) or before a join on that key. It always does the same, whatever
the input's size, files or the session's cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the session's shuffle partitions by ``keys``; micro-batches stay as they are planned."""
    if df.isStreaming:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
