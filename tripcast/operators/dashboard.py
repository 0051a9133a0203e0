"""Dashboard queries: filters, joins, group aggregates, top-k, option lists, profiling.

Inputs are the typed views of ``sources.loaders``. Every aggregate is a plain
``groupBy().agg()`` so Spark does a map-side partial aggregate before the
shuffle (a hot key costs one partial row per task, not a third of the
data in one task). Null keys are dropped before grouping, as pandas does.
Shares use a window over the *aggregated* rows (one row per category), never
over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import literal_frame


def _all():
    return Window.partitionBy()


# FLT1 / FLT2 — empty selection means no filter
def filter_years(df: DataFrame, years: Sequence[int] | None, date_col: str = "date") -> DataFrame:
    return df.where(F.year(date_col).isin(list(years))) if years else df


def filter_classes(df: DataFrame, classes: Sequence[str] | None) -> DataFrame:
    return df.where(F.col("flightType").isin(list(classes))) if classes else df


def value_counts(df: DataFrame, key: str | Sequence[str], name: str = "bookings") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_share(counts: DataFrame, name: str = "bookings") -> DataFrame:
    """Adds ``share`` (fraction of the total) and ``total``; window runs over the category rows only."""
    total = F.sum(name).over(_all())
    return counts.withColumns({"share": F.col(name) / total, "total": total})


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.avg(value).alias(name))


# AGG1 — KPI row (flights filtered by year; hotel KPIs unfiltered)
def kpi_row(flights: DataFrame, hotels: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    f = filter_years(flights, years)
    # one pass over flights: per destination (the null group included) count and price sums;
    # the totals and the modal destination both come from these few rows
    per_dest = f.groupBy("to_city").agg(F.count(F.lit(1)).alias("n"), F.sum("price_inr").alias("s"),
                                        F.count("price_inr").alias("k"))
    named = F.col("to_city").isNotNull()
    flight_part = per_dest.agg(
        F.sum("n").alias("n_flights"),
        (F.sum("s") / F.sum("k")).alias("avg_flight_inr"),
        F.min_by(F.when(named, F.col("to_city")), F.when(named, F.struct(-F.col("n"), F.col("to_city")))).alias("top_destination"),
        F.max(F.when(named, F.col("n"))).alias("top_destination_count"),
    )
    hotel_part = hotels.agg(
        F.count(F.lit(1)).alias("n_hotels"),
        F.avg("price_inr").alias("avg_hotel_inr"),
        F.sum("total_inr").alias("hotel_revenue_inr"),
    )
    # Two one-row frames stacked and folded into one row (no cross join).
    stacked = flight_part.unionByName(hotel_part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in
                        ["n_flights", "avg_flight_inr", "top_destination", "top_destination_count",
                         "n_hotels", "avg_hotel_inr", "hotel_revenue_inr"]])
    return row.select(
        (F.col("n_flights") + F.col("n_hotels")).alias("total_bookings"),
        "avg_flight_inr", "top_destination", "top_destination_count", "avg_hotel_inr",
        "hotel_revenue_inr", C.crore("hotel_revenue_inr").alias("hotel_revenue_crore"),
    )


# TOP3 — mode and its count; ties go to the smallest value
def top_value(df: DataFrame, key: str, name: str = "value", count_name: str = "count") -> DataFrame:
    counts = value_counts(df, key, "n")
    return counts.agg(
        F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias(name),
        F.max("n").alias(count_name),
    )


# AGG2
def monthly_price_by_class(flights: DataFrame, years=None, classes=None) -> DataFrame:
    f = filter_classes(filter_years(flights, years), classes).withColumn("month", C.month_start("date"))
    return group_mean(f, ["month", "flightType"], "price_inr", "avg_price_inr")


# AGG3
def monthly_bookings(flights: DataFrame, years=None, classes=None) -> DataFrame:
    f = filter_classes(filter_years(flights, years), classes).withColumn("month", C.month_start("date"))
    return value_counts(f, "month", "bookings")


# AGG4
def agency_share(flights: DataFrame, years=None, classes=None) -> DataFrame:
    return with_share(value_counts(filter_classes(filter_years(flights, years), classes), "agency"))


# AGG5
def class_mean_price(flights: DataFrame, years=None, classes=None) -> DataFrame:
    return group_mean(filter_classes(filter_years(flights, years), classes), ["flightType"], "price_inr", "avg_price_inr")


# AGG6
def hotel_monthly_price(hotels: DataFrame, years=None) -> DataFrame:
    h = filter_years(hotels, years).withColumn("month", C.month_start("date"))
    return group_mean(h, ["month"], "price_inr", "avg_price_inr")


# AGG7
def hotel_bookings(hotels: DataFrame, years=None) -> DataFrame:
    return value_counts(filter_years(hotels, years), "name").orderBy("bookings", "name")


# AGG8
def city_mean_price(hotels: DataFrame, years=None) -> DataFrame:
    return group_mean(filter_years(hotels, years), ["city"], "price_inr", "avg_price_inr").orderBy(F.desc("avg_price_inr"), "city")


# AGG9
def stay_lengths(hotels: DataFrame, years=None) -> DataFrame:
    return value_counts(filter_years(hotels, years), "days", "stays").orderBy("days")


# AGG10 / JOIN3 — the counts-merge-means pair is one aggregate
def destinations(flights: DataFrame) -> DataFrame:
    return (flights.where(F.col("to_city").isNotNull()).groupBy("to_city")
            .agg(F.count(F.lit(1)).alias("bookings"), F.avg("price_inr").alias("avg_price_inr")))


# AGG11 / TOP1 (+ PRJ14 label)
def top_routes(flights: DataFrame, n: int = 10) -> DataFrame:
    counts = value_counts(flights, ["from_city", "to_city"])
    return (counts.orderBy(F.desc("bookings"), "from_city", "to_city").limit(n)
            .withColumn("route", C.route_label("from_city", "to_city")))


# AGG12
def demographics(users: DataFrame) -> DataFrame:
    return value_counts(users.withColumn("age_group", C.age_band("age")), ["age_group", "gender"], "users")


# AGG13
def gender_split(users: DataFrame) -> DataFrame:
    return with_share(value_counts(users, "gender", "users"), "users")


# AGG14
def company_users(users: DataFrame) -> DataFrame:
    return value_counts(users, "company", "users")


# AGG15 — at most 20 equal-width integer bins
def age_histogram(users: DataFrame, bins: int = 20) -> DataFrame:
    ages = users.where(F.col("age").isNotNull())
    lo, hi = ages.agg(F.min("age"), F.max("age")).first()
    if lo is None:
        return ages.select(F.lit(0).alias("bin"), F.lit(0).alias("bin_start"), F.lit(0).alias("bin_end"),
                           F.lit(0).cast("long").alias("users")).limit(0)
    width = max(1, -(-(hi - lo + 1) // bins))
    b = F.floor((F.col("age") - lo) / width).cast("int")
    return (ages.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("users"))
            .select("bin", (F.col("bin") * width + lo).alias("bin_start"),
                    (F.col("bin") * width + lo + width).alias("bin_end"), "users"))


# JOIN1 — flights LEFT JOIN users (Spark picks the join by the sizes it meets at run time)
def flights_with_users(flights: DataFrame, users: DataFrame) -> DataFrame:
    u = users.withColumnRenamed("code", "userCode").withColumnRenamed("name", "name_user")
    return flights.join(u, "userCode", "left")


# JOIN2 — hotels LEFT JOIN users, clashing ``name`` suffixed ``_user``
def hotels_with_users(hotels: DataFrame, users: DataFrame) -> DataFrame:
    u = users.withColumnRenamed("code", "userCode").withColumnRenamed("name", "name_user")
    return hotels.join(u, "userCode", "left")


# AGG16 — mean flight price by gender over JOIN1.
# Flights are first reduced to one (sum, count) row per user, so the join
# moves customers, not orders; the mean is rebuilt exactly from sums.
def spend_by_gender(flights: DataFrame, users: DataFrame) -> DataFrame:
    per_user = (flights.where(F.col("price_inr").isNotNull()).groupBy("userCode")
                .agg(F.sum("price_inr").alias("s"), F.count(F.lit(1)).alias("n")))
    u = users.select(F.col("code").alias("userCode"), "gender")
    joined = per_user.join(u, "userCode", "left")
    return (joined.where(F.col("gender").isNotNull()).groupBy("gender")
            .agg((F.sum("s") / F.sum("n")).alias("avg_price_inr")))


# AGG17 — catalogue base, one row per hotel
def hotel_base(hotels: DataFrame) -> DataFrame:
    return (hotels.where(F.col("name").isNotNull() & F.col("place").isNotNull() & F.col("city").isNotNull())
            .groupBy("name", "place", "city")
            .agg(F.avg("price").alias("avg_price_per_night"), F.count("price").alias("bookings")))


# AGG18 — route means
def route_means(flights: DataFrame) -> DataFrame:
    return (flights.where(F.col("from").isNotNull() & F.col("to").isNotNull()).groupBy("from", "to")
            .agg(F.avg("distance").alias("avg_distance"), F.avg("time").alias("avg_time")))


# JOIN4 — route lookup with a default for unknown pairs
# Fixed values of the source application: default distance (km) and time (h).
ROUTE_DEFAULT_DISTANCE = 500.0
ROUTE_DEFAULT_TIME = 1.2


def route_lookup(requests: DataFrame, means: DataFrame) -> DataFrame:
    m = means.select("from", "to", "avg_distance", "avg_time")
    return (requests.join(m, ["from", "to"], "left")
            .withColumns({"distance": F.coalesce("avg_distance", F.lit(ROUTE_DEFAULT_DISTANCE)),
                          "time": F.coalesce("avg_time", F.lit(ROUTE_DEFAULT_TIME)),
                          "route_known": F.col("avg_distance").isNotNull()})
            .drop("avg_distance", "avg_time"))


# AGG19 — budget slider bound in INR
def budget_bound(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg((C.to_inr(F.max("avg_price_per_night")).cast("long") + 5000).alias("max_budget_inr"))


# TOP4 — preview rows
def preview(df: DataFrame, key: str, n: int = 200) -> DataFrame:
    return df.orderBy(key).limit(n)


# SORT1
def sort_by(df: DataFrame, metric: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    order = [F.col(metric).asc() if ascending else F.col(metric).desc()]
    return df.orderBy(*order, *([tie] if tie else []))


# SET1 — distinct city names over three columns
# Fixed values of the source application: the city list used when no data is present.
DEFAULT_CITIES = ["Florianopolis", "Salvador", "Natal", "Aracaju", "Recife",
                  "Sao Paulo", "Campo Grande", "Rio de Janeiro", "Brasilia"]


def unique_cities(flights: DataFrame, hotels: DataFrame) -> DataFrame:
    # one pass over flights (both city columns per row), one over hotels; with no city
    # at all the fixed list stands in (a left join from one row tells whether there is any)
    cities = (flights.select(F.explode(F.array("from_city", "to_city")).alias("city"))
              .union(hotels.select("city"))
              .where(F.col("city").isNotNull()).distinct())
    spark = flights.sparkSession
    found = cities.agg(F.count(F.lit(1)).alias("n"))
    stand_in = literal_frame(spark, [(c,) for c in DEFAULT_CITIES], ["city"]).where(found.scalar() == 0)
    return cities.unionByName(stand_in).orderBy("city")


# FLT7 — option lists as one long table, one pass over each view
def option_lists(flights: DataFrame, users: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("year").alias("option"), F.year("date").cast("string").alias("value")),
        F.struct(F.lit("flightType").alias("option"), F.col("flightType").alias("value")),
        F.struct(F.lit("from").alias("option"), F.col("from").alias("value")),
        F.struct(F.lit("agency").alias("option"), F.col("agency").alias("value")),
    )
    out = (flights.select(F.inline(pairs))
           .union(users.select(F.lit("company").alias("option"), F.col("company").alias("value"))))
    return out.where(F.col("value").isNotNull()).distinct().orderBy("option", "value")


# FLT5 — membership through a semi join
def members(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return df.join(allowed.select(key).distinct(), key, "left_semi")


# PRF1 — one pass: row count and null count of every column, unpivoted
def table_summary(df: DataFrame, name: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', '{t}', n{i}" for i, (c, t) in enumerate(df.dtypes))
    return wide.selectExpr(f"'{name}' AS table_name", "__rows AS row_count",
                           f"stack({len(df.columns)}, {pairs}) AS (column_name, dtype, null_count)")


# PRF2 — target distribution
def target_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = value_counts(df, label, "n")
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(_all())).orderBy(F.desc("n"), label)


# PRF3 — source badge
def source_badges(tables: dict[str, DataFrame | None]) -> DataFrame:
    frames = []
    for name, df in tables.items():
        if df is None:
            continue
        frames.append(df.select(F.lit(name).alias("source")).groupBy("source")
                      .agg(F.count(F.lit(1)).alias("rows")).withColumn("is_live", F.lit(True)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# PRF4 — home page counters
def home_stats(flights: DataFrame, hotels: DataFrame, users: DataFrame) -> DataFrame:
    stacked = (flights.select(F.lit(None).cast("string").alias("hotel"))
               .unionByName(hotels.select(F.col("name").alias("hotel")))
               .unionByName(users.select(F.lit(None).cast("string").alias("hotel"))))
    return stacked.agg(F.count_distinct("hotel").alias("distinct_hotels"),
                       F.count(F.lit(1)).alias("total_records"))
