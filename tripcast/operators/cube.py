"""Mergeable summary cube: the dashboard tabs (AGG1-AGG11) from one small table instead of raw bookings.

A cube holds, for every combination of its keys, the number of bookings and, for each
amount, how many bookings have one and their sum. Counts and sums add up, so cubes of
parts of the data merge into the cube of the whole (``merge``), and every tab is a
further sum over cube rows. Sums are decimals: they do not depend on order or grouping,
so a tab answered from a merged or refreshed cube equals one answered from a new build.

It is stored by booking year. ``refresh`` replaces the years it is given and leaves the
folders of all others as they are; a year whose bookings are all gone becomes empty.

Scale: one scan of the bookings with map-side combine. A cube has at most as many rows as
there are key combinations (months x classes x agencies x routes), whatever the number
of bookings, and a hot key costs one partial row per task.

Null keys are kept as a group of their own; a tab drops the nulls of its own keys, as the
plain queries do. Bookings without a readable date lie in the null year. An amount that is
null, not finite or beyond eighteen digits counts as missing. An empty table gives an empty cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import literal_frame
from .dashboard import with_share

FLIGHT_KEYS = ("month", "flightType", "agency", "from_city", "to_city")
HOTEL_KEYS = ("month", "name", "city", "days")
#: Type of an amount before it is summed; sums hold ten more digits.
AMOUNT = "decimal(18,4)"


def _build(bookings: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    rows = bookings.withColumns({"year": F.year("date"), "month": C.month_start("date")}).select(
        "year", *keys, *[F.col(a).try_cast(AMOUNT).alias(a) for a in amounts])
    parts = [f for a in amounts for f in (F.count(a).alias(f"{a}__n"), F.coalesce(F.sum(a), F.lit(0)).cast("decimal(28,4)").alias(f"{a}__sum"))]
    return rows.groupBy("year", *keys).agg(F.count(F.lit(1)).alias("bookings"), *parts)


def flight_cube(flights: DataFrame) -> DataFrame:
    """(year, month, flightType, agency, from_city, to_city, bookings, price_inr__n, price_inr__sum)."""
    return _build(flights, FLIGHT_KEYS, ["price_inr"])


def hotel_cube(hotels: DataFrame) -> DataFrame:
    """(year, month, name, city, days, bookings, and number and sum of price_inr and total_inr)."""
    return _build(hotels, HOTEL_KEYS, ["price_inr", "total_inr"])


def _measures(cube: DataFrame) -> list[str]:
    return [c for c in cube.columns if c == "bookings" or "__" in c]


def merge(*cubes: DataFrame) -> DataFrame:
    """The cube of all bookings behind ``cubes`` (disjoint parts of the data)."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    types = dict(out.dtypes)
    keys = [c for c in out.columns if c not in _measures(out)]
    return out.groupBy(*keys).agg(*[F.sum(m).cast(types[m]).alias(m) for m in _measures(out)])


def _in_years(years: Sequence[int | None]) -> Column:
    known = [y for y in years if y is not None]
    found = F.coalesce(F.col("year").isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col("year").isNull() if None in years else found


def refresh(cube: DataFrame, path: str, years: Sequence[int | None] | None = None) -> None:
    """Write ``cube`` to ``path``: whole, or only ``years`` (None: bookings without a date), whose folders are replaced."""
    # a row of no bookings for each year that is written, so a year that has lost all its bookings is replaced, too
    types = dict(cube.dtypes)
    blank = literal_frame(cube.sparkSession, [(y if y is not None else -1,) for y in (years or [None])], ["y"])
    marks = blank.select(F.when(F.col("y") >= 0, F.col("y")).cast(types["year"]).alias("year"),
                         *[F.lit(0 if c in _measures(cube) else None).cast(types[c]).alias(c) for c in cube.columns if c != "year"])
    rows = (cube if years is None else cube.where(_in_years(years))).unionByName(marks)
    (rows.hint("rebalance", "year").write.mode("overwrite")
     .option("partitionOverwriteMode", "static" if years is None else "dynamic").partitionBy("year").parquet(path))


def load(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """The stored cube; ``years`` prunes folders."""
    df = spark.read.parquet(path).where(F.col("bookings") > 0)
    return df.where(F.col("year").isin(list(years))) if years else df


# ---------------------------------------------------------------- tabs
def _of(cube: DataFrame, years: Sequence[int] | None, classes: Sequence[str] | None = None) -> DataFrame:
    df = cube.where(F.col("year").isin(list(years))) if years else cube
    return df.where(F.col("flightType").isin(list(classes))) if classes else df


def _present(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        cube = cube.where(F.col(k).isNotNull())
    return cube


def _mean(amount: str) -> Column:
    return F.try_divide(F.sum(f"{amount}__sum").cast("double"), F.sum(f"{amount}__n"))


def counts(cube: DataFrame, keys: Sequence[str], name: str = "bookings") -> DataFrame:
    return _present(cube, keys).groupBy(*keys).agg(F.sum("bookings").alias(name))


def means(cube: DataFrame, keys: Sequence[str], amount: str = "price_inr") -> DataFrame:
    return _present(cube, keys).groupBy(*keys).agg(_mean(amount).alias(f"avg_{amount}"))


def kpi_row(flights: DataFrame, hotels: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """AGG1: flights of ``years``, all hotels."""
    to = F.col("to_city")
    per_city = _of(flights, years).groupBy("to_city").agg(*[F.sum(m).alias(m) for m in _measures(flights)])
    flight_part = per_city.agg(
        F.coalesce(F.sum("bookings"), F.lit(0)).alias("n"), _mean("price_inr").alias("avg_flight_inr"),
        F.min_by(to, F.when(to.isNotNull(), F.struct(-F.col("bookings"), to))).alias("top_destination"),
        F.max(F.when(to.isNotNull(), F.col("bookings"))).alias("top_destination_count"))
    hotel_part = hotels.agg(
        F.coalesce(F.sum("bookings"), F.lit(0)).alias("n"), _mean("price_inr").alias("avg_hotel_inr"),
        F.when(F.sum("total_inr__n") > 0, F.sum("total_inr__sum").cast("double")).alias("hotel_revenue_inr"))
    stacked = flight_part.unionByName(hotel_part, allowMissingColumns=True)
    names = [c for c in stacked.columns if c != "n"]
    row = stacked.agg(F.sum("n").alias("total_bookings"), *[F.max(c).alias(c) for c in names])
    return row.withColumn("hotel_revenue_crore", C.crore("hotel_revenue_inr"))


def monthly_price_by_class(flights: DataFrame, years=None, classes=None) -> DataFrame:
    return means(_of(flights, years, classes), ["month", "flightType"])


def monthly_bookings(flights: DataFrame, years=None, classes=None) -> DataFrame:
    return counts(_of(flights, years, classes), ["month"])


def agency_share(flights: DataFrame, years=None, classes=None) -> DataFrame:
    # the window runs over the agencies, one row each
    return with_share(counts(_of(flights, years, classes), ["agency"]))


def class_mean_price(flights: DataFrame, years=None, classes=None) -> DataFrame:
    return means(_of(flights, years, classes), ["flightType"])


def hotel_monthly_price(hotels: DataFrame, years=None) -> DataFrame:
    return means(_of(hotels, years), ["month"])


def hotel_bookings(hotels: DataFrame, years=None) -> DataFrame:
    return counts(_of(hotels, years), ["name"]).orderBy("bookings", "name")


def city_mean_price(hotels: DataFrame, years=None) -> DataFrame:
    return means(_of(hotels, years), ["city"]).orderBy(F.desc("avg_price_inr"), "city")


def stay_lengths(hotels: DataFrame, years=None) -> DataFrame:
    return counts(_of(hotels, years), ["days"], "stays").orderBy("days")


def destinations(flights: DataFrame) -> DataFrame:
    return _present(flights, ["to_city"]).groupBy("to_city").agg(F.sum("bookings").alias("bookings"), _mean("price_inr").alias("avg_price_inr"))


def top_routes(flights: DataFrame, n: int = 10) -> DataFrame:
    return (counts(flights, ["from_city", "to_city"]).orderBy(F.desc("bookings"), "from_city", "to_city").limit(n)
            .withColumn("route", C.route_label("from_city", "to_city")))
