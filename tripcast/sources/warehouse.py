"""Materialised travel tables: derive once, query many times.

Every catalogue query can derive the travel views from the driver tables
(``sources.loaders``). A dashboard that runs many queries over the same data
writes the typed views once instead, partitioned by booking year, and reads
them back: the year filter of the dashboard (FLT1) then becomes partition
pruning (``PartitionFilters`` in the scan) and the joins behind the views run
once. Rows whose date did not parse land in the ``year=__HIVE_DEFAULT_PARTITION__``
folder and are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import loaders as L

# Rows of one file.
MAX_RECORDS = 5_000_000


def materialize(spark: SparkSession, sf_dir: str, out: str) -> dict[str, str]:
    """Write flights and hotels (partitioned by ``year``) and users under ``out``."""
    paths = {"flights": f"{out}/flights", "hotels": f"{out}/hotels", "users": f"{out}/users"}
    for name, df in [("flights", L.load_flights(spark, sf_dir)), ("hotels", L.load_hotels(spark, sf_dir))]:
        (df.withColumn("year", F.year("date"))
         # the rows of a year meet, and a year that outgrows a partition is split over several writers
         .hint("rebalance", "year")
         .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS).partitionBy("year").parquet(paths[name]))
    L.load_users(spark, sf_dir).write.mode("overwrite").parquet(paths["users"])
    return paths


def _read(spark: SparkSession, path: str, years: Sequence[int] | None) -> DataFrame:
    df = spark.read.parquet(path)
    if years:
        df = df.where(F.col("year").isin(list(years)))  # partition pruning
    return df.drop("year")


def load_flights(spark: SparkSession, out: str, years: Sequence[int] | None = None) -> DataFrame:
    return _read(spark, f"{out}/flights", years)


def load_hotels(spark: SparkSession, out: str, years: Sequence[int] | None = None) -> DataFrame:
    return _read(spark, f"{out}/hotels", years)


def load_users(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/users")
