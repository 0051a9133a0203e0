"""Sources (SRC family): raw and typed travel views, optional CSV sources, request parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions import columns as C
from . import fixtures, schemas


# SRC1 / SRC2 — raw tables (string date, USD), from the driver-derived stand-ins.
def load_flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.flights(spark, sf_dir)


def load_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.users(spark, sf_dir)


def load_hotels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.hotels(spark, sf_dir)


# SRC3 — typed flights view
def type_flights(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "date": C.parse_date_lenient("date"),
        "price_inr": C.to_inr("price"),
        "from_city": C.city_of("from"),
        "to_city": C.city_of("to"),
    })


# SRC4 — typed hotels view
def type_hotels(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "date": C.parse_date_lenient("date"),
        "price_inr": C.to_inr("price"),
        "total_inr": C.to_inr("total"),
        "city": C.city_of("place"),
        "state_code": C.state_of("place"),
    })


def load_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_flights(load_flights_raw(spark, sf_dir))


def load_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_hotels(load_hotels_raw(spark, sf_dir))


# SRC1/SRC2 on real files: header CSV with a declared schema, malformed rows kept aside.
def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(with_corrupt)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .csv(path))


# SRC5 — optional source: a missing path yields None and callers degrade.
def load_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame | None:
    try:
        if fmt == "csv":
            df = read_csv(spark, path, schema)
        else:
            df = spark.read.schema(schema).format(fmt).load(path)
        df.schema  # resolve the path now
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


# SRC6 — the five-row fallback catalogue (fixed values of the source application).
FALLBACK_HOTELS = [
    ("The Oberoi Udaivilas", "Udaipur", "India", "luxury", "arid / hot", 5, 850.0, 9.6,
     "pool spa wifi fine_dining gym butler_service", "leisure honeymoon romantic", 0),
    ("Taj Lake Palace", "Udaipur", "India", "heritage / palace", "arid / hot", 5, 920.0, 9.4,
     "pool spa wifi fine_dining bar butler_service", "leisure honeymoon romantic", 0),
    ("ITC Grand Chola", "Chennai", "India", "luxury", "tropical", 5, 420.0, 9.1,
     "pool spa wifi fine_dining gym business_center bar", "business leisure", 0),
    ("Radisson Blu Bengaluru", "Bengaluru", "India", "business", "temperate", 4, 180.0, 8.5,
     "pool wifi gym business_center bar fine_dining", "business", 0),
    ("Zostel Goa", "Goa", "India", "budget / backpacker", "tropical", 2, 25.0, 8.1,
     "wifi bar beach_access", "adventure budget leisure", 0),
]


def fallback_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK_HOTELS, schemas.HOTEL_CATALOGUE)


# SRC7 — parse request JSON text; malformed text gives NULL fields, never an exception.
def parse_requests(df: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """Adds ``req`` (typed struct) and ``req_map`` (map form: NULL = malformed, {} = empty).

    Both parses are produced by one generator row per input row, so a later
    filter on fields of the parse (e.g. a routing status) is evaluated on the
    parsed columns instead of being rewritten into repeated parses."""
    parsed = F.struct(
        F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"}).alias("req"),
        F.from_json(F.col(text_col), T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"}).alias("req_map"),
    )
    return df.select("*", F.inline(F.array(parsed)))
