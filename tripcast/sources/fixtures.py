"""Travel tables (flights, hotels, users) derived from the driver's tables.

The source application ships no data, so the three tables it reads are
stand-ins computed from the TPC-H-like parquet files (rules in FIXTURES.md).
They are ordinary lazy DataFrames: every query that uses them is planned
end-to-end by Catalyst, so only the needed driver columns are scanned.

Scale notes
* ``flights`` = orders LEFT JOIN customer (one row per order). Both sides
  grow with the data, so this is a sort-merge join on the customer key;
  AQE splits a hot customer key if one appears.
* ``hotels`` = lineitem JOIN orders JOIN part. lineitem/orders are joined
  on the order key (sort-merge), part on the part key. The lineitem scan is
  ``by_key`` (a no-op when the scan already has enough partitions), because
  three joins and the date formatting per row follow it.
* ``nation`` is the only broadcast side, behind a checked row bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import app_id, checked_broadcast
from .tables import by_key, table

# Fixed values of the stand-in data (FIXTURES.md): first names cycled by key.
FIRST_NAMES = ["Ana", "Bruno", "Carla", "Diego", "Elisa", "Fabio"]

# Nation rows are bounded (25 in the generator); the proof is cached per path.
_NATION_CACHE: dict[str, DataFrame] = {}


def place_label(name: Column, nationkey: Column, regionkey: Column) -> Column:
    """``NATION 2 (CC)`` — the ``City (ST)`` shape of the source data."""
    return F.concat(
        F.regexp_replace(name, "_", " "), F.lit(" ("),
        F.chr(nationkey + 65), F.chr(regionkey + 65), F.lit(")"),
    )


def nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = f"{app_id(spark)}:{sf_dir}"
    if key not in _NATION_CACHE:
        n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
        places = n.select("n_nationkey", place_label(F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")).alias("place"))
        _NATION_CACHE[key] = checked_broadcast(places)
    return _NATION_CACHE[key]


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights table (SRC1 shape): string date, USD price."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    places = nation_places(spark, sf_dir)
    src = places.select(F.col("n_nationkey").alias("c_nationkey"), F.col("place").alias("from"))
    dst = places.select(F.col("n_nationkey").alias("to_key"), F.col("place").alias("to"))

    df = (
        o.join(c, o["o_custkey"] == c["c_custkey"], "left")
        .withColumn("to_key", (F.col("o_orderkey") % 25).cast("int"))
        .join(src, "c_nationkey", "left")
        .join(dst, "to_key", "left")
    )
    prio = F.col("o_orderpriority")
    class_ = (F.when(prio == "1-URGENT", "firstClass")
              .when(prio.isin("2-HIGH", "3-MEDIUM"), "premium")
              .otherwise("economic"))
    base = (F.when(prio == "1-URGENT", 1500)
            .when(prio.isin("2-HIGH", "3-MEDIUM"), 700)
            .otherwise(280))
    distance = (F.abs(F.col("c_nationkey") - F.col("to_key")) * 37 + 100).cast("double")
    status = F.col("o_orderstatus")
    return df.select(
        F.col("o_orderkey").alias("travelCode"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 89 == 0, 1_000_000).otherwise(0)).alias("userCode"),
        F.col("from"),
        F.col("to"),
        class_.alias("flightType"),
        (distance / 2 + base + F.floor("o_totalprice").cast("long") % 100).alias("price"),
        (distance / 512).alias("time"),
        distance.alias("distance"),
        F.when(status == "P", "CloudFy").when(status == "F", "FlyingDrops").otherwise("Rainbow").alias("agency"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit("bad-date"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date"),
    )


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hotels table: one booking per lineitem, hotel = part brand."""
    # dealt out by the key of the join that follows
    li = by_key(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_retailprice")
    places = nation_places(spark, sf_dir).withColumnRenamed("n_nationkey", "brand_key")
    brand_no = F.substring("p_brand", 7, 8).cast("int")
    price = F.floor("p_retailprice").cast("double") - 880 + brand_no * 8
    df = (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(p, li["l_partkey"] == p["p_partkey"])
        .withColumn("brand_key", brand_no - 1)
        .join(places, "brand_key", "left")
    )
    return df.select(
        F.col("l_orderkey").alias("travelCode"),
        F.col("o_custkey").alias("userCode"),
        F.col("p_brand").alias("name"),
        F.col("place"),
        F.col("l_linenumber").alias("days"),
        price.alias("price"),
        (price * F.col("l_linenumber")).alias("total"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("date"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users table: one row per customer, with null names and ages sprinkled in."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    key = F.col("c_custkey")
    first = F.element_at(F.array(*[F.lit(n) for n in FIRST_NAMES]), (key % 6 + 1).cast("int"))
    return c.select(
        key.alias("code"),
        F.col("c_mktsegment").alias("company"),
        F.when(key % 71 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(first, F.lit(" "), F.col("c_name"))).alias("name"),
        F.when(key % 10 == 9, "none").when(key % 2 == 0, "female").otherwise("male").alias("gender"),
        F.when(key % 53 == 0, F.lit(None).cast("int"))
        .otherwise(F.floor(F.abs("c_acctbal")).cast("int") % 88 + 16).alias("age"),
    )


def hotel_requests(flights_typed: DataFrame) -> DataFrame:
    """One hotel request per flight booking (REC10 input that grows with the data).

    Economy travellers type the full place label ("NATION 3 (DA)"), which is no
    catalogue city, so they exercise the no-survivor and unknown-destination paths.
    """
    ft, ag = F.col("flightType"), F.col("agency")
    return flights_typed.select(
        F.col("travelCode").alias("request_id"),
        F.when(ft == "economic", F.col("to")).otherwise(F.col("to_city")).alias("destination"),
        F.when(ft == "firstClass", "luxury").when(ft == "premium", "business").otherwise("budget").alias("style"),
        F.when(ag == "CloudFy", "coastal").when(ag == "Rainbow", "temperate").alias("climate"),
        F.when(ag == "CloudFy", "leisure").when(ag == "FlyingDrops", "business").alias("travel_type"),
        F.when(ft == "firstClass", F.array(F.lit("spa"), F.lit("fine_dining")))
        .when(ft == "premium", F.array(F.lit("wifi"), F.lit("gym")))
        .otherwise(F.array(F.lit("wifi"))).alias("amenities"),
        F.floor(F.col("price") / 4).cast("double").alias("budget_max"),
        F.when(ft == "firstClass", 4).when(ft == "premium", 3).otherwise(0).alias("min_stars"),
        F.when(ft == "firstClass", 7.5).otherwise(0.0).alias("min_review"),
    )
