"""Scalar column expressions (the PRJ family).

All are built-in Spark expressions, so they compile into whole-stage codegen
and never leave the JVM. Each takes and returns ``Column`` objects so one
definition is shared by training, dashboard and scoring jobs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the source application.
USD_TO_INR = 83.0
CURRENCY_SYMBOL = "₹"
PLACE_CITY = r"^(.*?)\s*\("          # "City (ST)" -> City
PLACE_STATE = r"\(([A-Z]{2})\)"       # "City (ST)" -> ST
DATE_FORMAT = "M/d/yyyy"              # month/day/year, zero padding optional
FLIGHT_TYPE_LABELS = {"economic": "Economy", "premium": "Premium", "firstClass": "First Class"}
AGE_BANDS = [(18, 25, "18–24"), (25, 35, "25–34"), (35, 45, "35–44"),
             (45, 55, "45–54"), (55, 65, "55–64"), (65, 100, "65+")]
FLIGHT_ID_COLUMNS = ["travelCode", "userCode"]
USER_ID_COLUMNS = ["code"]
CALENDAR_DEFAULTS = {"day": 15, "month": 6, "weekday": 2}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# PRJ1
def drop_ids(df: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Drop id columns that exist; absent names are ignored."""
    return df.drop(*[c for c in ids if c in df.columns])


# PRJ2
def parse_date_lenient(c: str | Column) -> Column:
    """``M/d/yyyy`` text -> DATE; malformed text becomes NULL."""
    return F.to_date(F.try_to_timestamp(col(c), F.lit(DATE_FORMAT)))


# PRJ3
def parse_date_strict(c: str | Column) -> Column:
    """``M/d/yyyy`` text -> DATE; malformed text fails the job (ANSI)."""
    return F.to_date(col(c), DATE_FORMAT)


def calendar_parts(d: str | Column) -> dict[str, Column]:
    """month, day and weekday *name* of a date (training form)."""
    d = col(d)
    return {"month": F.month(d), "day": F.dayofmonth(d), "weekday": F.date_format(d, "EEEE")}


# PRJ4
def to_inr(c: str | Column) -> Column:
    """USD -> INR rounded half-to-even to whole rupees."""
    return F.bround(col(c) * USD_TO_INR, 0)


# PRJ5
def city_of(place: str | Column) -> Column:
    """Text before `` (`` of ``City (ST)``; the whole string when there is no match."""
    p = col(place)
    return F.when(p.rlike(PLACE_CITY), F.regexp_extract(p, PLACE_CITY, 1)).otherwise(p)


# PRJ6
def state_of(place: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(place), PLACE_STATE, 1), F.lit(""))


# PRJ7
def name_features_training(name: str | Column) -> dict[str, Column]:
    """First token, its length, first and last character; case kept, null stays null."""
    first = F.nullif(F.regexp_extract(col(name), r"(\S+)", 1), F.lit(""))
    return {
        "first_name": first,
        "name_length": F.length(first),
        "first_letter": F.left(first, F.lit(1)),
        "last_letter": F.right(first, F.lit(1)),
    }


# PRJ8
def name_features_serving(first_name: str | Column) -> dict[str, Column]:
    """Request form: trimmed name, upper first char, lower last char."""
    clean = F.trim(col(first_name))
    return {
        "first_name": clean,
        "name_length": F.length(clean),
        "first_letter": F.upper(F.left(clean, F.lit(1))),
        "last_letter": F.lower(F.right(clean, F.lit(1))),
    }


# PRJ9
def name_codes(name: str | Column) -> dict[str, Column]:
    """Integer name codes; null or empty name -> length 0, letters 'A'/'a'."""
    n = F.coalesce(col(name), F.lit(""))
    token = F.regexp_extract(n, r"(\S+)", 1)
    empty = n == ""
    return {
        "name_length": F.when(empty, 0).otherwise(F.length(token)),
        "first_letter_enc": F.when(empty, 0).otherwise(F.ascii(F.upper(F.left(n, F.lit(1)))) - 65),
        "last_letter_enc": F.when(empty, 0).otherwise(F.ascii(F.lower(F.right(token, F.lit(1)))) - 97),
    }


# PRJ10
def calendar_codes(d: str | Column) -> dict[str, Column]:
    """Numeric day, month, weekday (Monday = 0) with the defaults 15, 6, 2."""
    d = col(d)
    return {
        "day": F.coalesce(F.dayofmonth(d), F.lit(CALENDAR_DEFAULTS["day"])),
        "month": F.coalesce(F.month(d), F.lit(CALENDAR_DEFAULTS["month"])),
        "weekday": F.coalesce(F.weekday(d), F.lit(CALENDAR_DEFAULTS["weekday"])),
    }


# PRJ12
def flight_type_label(c: str | Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FLIGHT_TYPE_LABELS.items() for x in kv])
    return F.try_element_at(m, col(c))


def flight_type_code(label: str | Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FLIGHT_TYPE_LABELS.items() for x in reversed(kv)])
    return F.try_element_at(m, col(label))


# PRJ13
def fmt_inr(usd: str | Column) -> Column:
    return F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(to_inr(usd), 0))


# PRJ14
def route_label(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws(" → ", col(a), col(b))


# PRJ15
def amenity_labels(tokens: str | Column) -> Column:
    return F.transform(col(tokens), lambda x: F.initcap(F.regexp_replace(x, "_", " ")))


def amenity_tokens(labels: str | Column) -> Column:
    return F.transform(col(labels), lambda x: F.lower(F.regexp_replace(x, " ", "_")))


# PRJ16
def crore(c: str | Column) -> Column:
    return F.format_number(col(c) / 1e7, 2)


# PRJ17
def price_band(c: str | Column) -> dict[str, Column]:
    return {"price_low": col(c) * 0.88, "price_high": col(c) * 1.18}


# PRJ18
def confidence_band(c: str | Column) -> Column:
    c = col(c)
    return F.when(c >= 0.8, "high").when(c >= 0.6, "moderate").otherwise("low")


# PRJ19
def budget_use(price: str | Column, budget: str | Column) -> dict[str, Column]:
    pct = F.try_divide(col(price), col(budget)) * 100
    return {"budget_used_pct": pct,
            "budget_band": F.when(pct <= 80, "within").otherwise("close")}


# PRJ21
def age_band(c: str | Column) -> Column:
    """Left-closed bands [18,25) ... [65,100); anything outside is NULL."""
    c = col(c)
    expr = None
    for lo, hi, label in AGE_BANDS:
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


# PRJ22
def month_start(d: str | Column) -> Column:
    return F.trunc(col(d), "month")
