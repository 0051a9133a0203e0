"""Operator 3, sharding: a permutation-filled lookup table.

Every shard owns a preference order over the slots of a prime-sized table (an
offset and a step from its name's digest). The shards take turns; in its turn a
shard claims its first slot that is still free, until none is free. A document
goes to the shard of slot ``digest(key) mod table size``: placement costs one
lookup, shards get near-equal parts, and adding or removing a shard moves few
other documents.

Scale: the table has ``table_size`` rows whatever the input (the bound that
allows the broadcast); placement is a projection and a broadcast hash join, so
there is no shuffle and a hot source spreads like any other (the key is the
document id).

Defined cases: a null key is placed like the empty text; equal keys share a
shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table slots: prime, at least 100 for each of the default shards.
TABLE_SIZE = 2_003
N_SHARDS = 16


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of every slot. A shard's order is (offset + j * step) mod size, a permutation as size is prime."""
    if not names or not is_prime(size) or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and not empty, the table size prime")
    offset = [_digest(f"offset|{n}") % size for n in names]
    step = [_digest(f"step|{n}") % (size - 1) + 1 for n in names]
    at = [0] * len(names)
    table = [-1] * size
    free = size
    while free:
        for i in range(len(names)):
            while table[slot := (offset[i] + at[i] * step[i]) % size] >= 0:
                at[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup_frame(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    table = fill_table(names, size)
    return (spark.range(1).select(F.posexplode(F.lit(table)).alias("slot", "shard_id"))
            .select(F.col("slot").cast("long").alias("slot"), F.col("shard_id").cast("long").alias("shard_id")))


def assign_shards(docs: DataFrame, key_col: str = "doc_id", names: list[str] | None = None,
                  size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, slot, shard_id) for every row."""
    names = names or shard_names()
    keyed = docs.select(F.col(key_col).alias("doc_id"), slot_of(F.col(key_col), size).alias("slot"))
    return keyed.join(F.broadcast(lookup_frame(docs.sparkSession, names, size)), "slot").select("doc_id", "slot", "shard_id")


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", names: list[str] | None = None,
                 size: int = TABLE_SIZE, rows_per_file: int = 1_000_000, salts: int = 8) -> None:
    """Write all columns in one folder per shard; each shard is written by up to ``salts`` tasks."""
    names = names or shard_names()
    table = lookup_frame(docs.sparkSession, names, size).withColumnsRenamed({"slot": "_slot", "shard_id": "_shard"})
    placed = docs.withColumn("_slot", slot_of(F.col(key_col), size)).join(F.broadcast(table), "_slot").drop("_slot")
    salt = F.pmod(F.xxhash64(F.col(key_col)), F.lit(salts))
    (placed.repartition(len(names) * salts, "_shard", salt).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(path))
