"""Co-partitioned storage for joins on the user code (JOIN1, JOIN2): bookings and users meet without an exchange.

Both tables are written in the same number of buckets of (user code, slot), sorted by
them, so a join on both columns reads bucket against bucket. The slot is what keeps a
hot user from filling one bucket: a user with more than a bucket's fair share of the
bookings is dealt over as many slots as it holds shares, by a hash of the booking, and
the user's row is stored once for each of its slots. All others have slot 0.

Bounds: fewer users than buckets can hold more than a share each, and their slots sum up
to less than twice the buckets; so the table of hot users, which is broadcast, and the
added user rows are that small whatever the data. Bookings of a null user code match
nothing and are dealt over all slots.

A user without bookings keeps one row; a booking without a user keeps its row with nulls
(left join); a repeated user code repeats the booking, as the plain join does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, SLOT = "userCode", "user_slot"
#: Buckets of a table; part of its layout, so it is a parameter. Some hundred megabytes a bucket are a good size.
BUCKETS = 64


@dataclass(frozen=True)
class Colocated:
    """Names of the stored tables and where their files are."""

    bookings: str
    users: str
    folder: str
    buckets: int


def hot_users(bookings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(userCode, slots): users with more than 1/buckets of all bookings that have a user; fewer than ``buckets`` rows."""
    counts = bookings.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"))
    return (counts.where(F.col("n") * buckets > total.scalar())
            .select(KEY, F.ceil(F.col("n") * buckets / total.scalar()).cast("int").alias("slots")))


def _spread(key: Column, slots: Column) -> Column:
    return F.pmod(key, slots).cast("int")


def _save(df: DataFrame, name: str, path: str, buckets: int) -> None:
    # one writer for each bucket, by the hash the buckets use
    (df.repartition(buckets, KEY, SLOT).write.format("parquet").mode("overwrite").option("path", path)
     .bucketBy(buckets, KEY, SLOT).sortBy(KEY, SLOT).saveAsTable(name))


def store(bookings: DataFrame, users: DataFrame, folder: str, name: str, key: str = "travelCode", buckets: int = BUCKETS) -> Colocated:
    """Write ``bookings`` (flights or hotels) and ``users`` as tables ``name``_bookings and ``name``_users under ``folder``."""
    out = Colocated(f"{name}_bookings", f"{name}_users", folder, buckets)
    hot = hot_users(bookings, buckets)
    booking_hash = F.xxhash64(*[F.col(c) for c in bookings.columns if c != KEY]) if key not in bookings.columns else F.xxhash64(key)
    slotted = bookings.join(F.broadcast(hot), KEY, "left").withColumn(
        SLOT, F.when(F.col(KEY).isNull(), _spread(booking_hash, F.lit(buckets)))
        .when(F.col("slots").isNull(), 0).otherwise(_spread(booking_hash, F.coalesce("slots", F.lit(1)))))
    _save(slotted.select(*bookings.columns, SLOT), out.bookings, f"{folder}/{name}_bookings", buckets)
    # the join key has the bookings' type: a cast inside the join would hide the buckets
    key_type = dict(bookings.dtypes)[KEY]
    u = users.withColumnRenamed("name", "name_user").withColumn(KEY, F.col("code").cast(key_type)).drop("code")
    copies = u.join(F.broadcast(hot), KEY, "left").withColumn(SLOT, F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)))
    _save(copies.select(*u.columns, SLOT), out.users, f"{folder}/{name}_users", buckets)
    return out


def attach(spark: SparkSession, stored: Colocated) -> None:
    """Name the stored files in the catalogue of another session."""
    for table in (stored.bookings, stored.users):
        path = f"{stored.folder}/{table}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
                  f"CLUSTERED BY ({KEY}, {SLOT}) SORTED BY ({KEY}, {SLOT}) INTO {stored.buckets} BUCKETS LOCATION '{path}'")


def with_users(spark: SparkSession, stored: Colocated) -> DataFrame:
    """Bookings LEFT JOIN users, bucket against bucket; the columns of the plain join. The merge hint keeps Spark from
    moving a small users table to all tasks instead."""
    u = spark.table(stored.users).hint("merge")
    return spark.table(stored.bookings).join(u, [KEY, SLOT], "left").drop(SLOT)
