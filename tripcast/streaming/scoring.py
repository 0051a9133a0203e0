"""Scoring jobs (SCR family) that run unchanged on batch or Structured Streaming input.

The request/response service of the source application becomes a table
transform: request rows in, response rows out. Parsing (SRC7), validation
(FLT6) and model scoring are per-row expressions, so the same function works
on ``spark.read`` and ``spark.readStream`` frames. Ranking recommendations
needs a whole request at once, so the streaming form of SCR3 runs the batch
recommender inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import loaders as L
from ..sources import schemas
from ..sources.tables import by_key

MODEL_VERSION = "tripcast_v1"
FALLBACK_VERSION = "local_fallback_v1"

FLIGHT_REQUIRED = ["flightType", "agency", "from", "to"]


def flight_request_text(flights_features: DataFrame) -> DataFrame:
    """JSON request bodies built from the flight feature rows; rows without a valid date carry their raw text."""
    body = F.to_json(F.struct(*[F.col(f.name) for f in schemas.FLIGHT_REQUEST.fields]))
    return flights_features.select(F.col("travelCode").alias("request_id"),
                                   F.when(F.col("date_ok"), body).otherwise(F.col("raw_date")).alias("body"))


# FLT6 / SCR4 — validation and routing; never raises
def route_requests(requests: DataFrame, body: str = "body", key: str = "request_id") -> DataFrame:
    parsed = L.parse_requests(by_key(requests, key if key in requests.columns else body), body, schemas.FLIGHT_REQUEST)
    r, m = F.col("req"), F.col("req_map")
    missing = None
    for c in FLIGHT_REQUIRED:
        cond = r[c].isNull()
        missing = cond if missing is None else missing | cond
    status = (F.when(m.isNull(), "error").when(F.size(m) == 0, "error").when(missing, "error")
              .when(r["from"] == r["to"], "rejected").otherwise("valid"))
    message = (F.when(m.isNull(), "Invalid JSON payload").when(F.size(m) == 0, "No input data provided")
               .when(missing, "Missing required fields")
               .when(r["from"] == r["to"], "Origin and destination must differ"))
    return parsed.withColumns({"status": status, "message": message})


# FLT6 — classify requests: malformed / empty bodies are errors, a blank first name is rejected
def route_classify_requests(requests: DataFrame, body: str = "body", key: str = "request_id") -> DataFrame:
    parsed = L.parse_requests(by_key(requests, key if key in requests.columns else body), body, schemas.CLASSIFY_REQUEST)
    r, m = F.col("req"), F.col("req_map")
    blank = F.coalesce(F.trim(r["first_name"]), F.lit("")) == ""
    status = (F.when(m.isNull(), "error").when(F.size(m) == 0, "error")
              .when(blank, "rejected").otherwise("valid"))
    message = (F.when(m.isNull(), "Invalid JSON payload").when(F.size(m) == 0, "No input data provided")
               .when(blank, "The first name is blank"))
    return parsed.withColumns({"status": status, "message": message})


def split_valid(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantine) — two filters over one parse."""
    return routed.where(F.col("status") == "valid"), routed.where(F.col("status") != "valid")


# FLT6 — hotel requests: every field is optional, but the body must be a JSON object with some
def route_hotel_requests(requests: DataFrame, body: str = "body", key: str = "request_id") -> DataFrame:
    parsed = L.parse_requests(by_key(requests, key if key in requests.columns else body), body, schemas.HOTEL_REQUEST)
    m = F.col("req_map")
    status = F.when(m.isNull(), "error").when(F.size(m) == 0, "error").otherwise("valid")
    message = F.when(m.isNull(), "Invalid JSON payload").when(F.size(m) == 0, "No input data provided")
    return parsed.withColumns({"status": status, "message": message})


def _answered(requests: DataFrame, fields: list[str]) -> tuple[Column, Column, list[str]]:
    """(may be scored, status of the answer, columns that are carried). Routed requests keep their own status:
    each gets one answer, and only valid ones get a score."""
    carried = [c for c in requests.columns if c not in fields and c != "status"]
    if "status" not in requests.columns:
        return F.lit(True), F.lit("success"), carried
    ok = F.col("status") == "valid"
    return ok, F.when(ok, "success").otherwise(F.col("status")), carried


# SCR1 — price scoring
def score_prices(model: PipelineModel, requests: DataFrame, version: str = MODEL_VERSION) -> DataFrame:
    fields = [f.name for f in schemas.FLIGHT_REQUEST.fields]
    ok, status, carried = _answered(requests, fields)
    scored = model.transform(requests.withColumn("input_received", F.struct(*fields)))
    return scored.select(
        *carried,
        status.alias("status"),
        F.when(ok, F.round("prediction", 2)).alias("predicted_price"),
        F.when(ok, F.lit("USD")).alias("currency"),
        F.when(ok, F.lit(version)).alias("model_version"),
        "input_received",
    )


# SCR2 — class scoring with per-class probabilities (4 dp)
def score_classes(model: PipelineModel, requests: DataFrame, labels: list[str], echo_cols: list[str],
                  version: str = MODEL_VERSION) -> DataFrame:
    from ..operators.ml import probability_columns
    from pyspark.ml.feature import IndexToString

    ok, status, carried = _answered(requests, echo_cols)
    scored = model.transform(requests.withColumn("input_received", F.struct(*[F.col(c) for c in echo_cols])))
    scored = IndexToString(inputCol="prediction", outputCol="predicted_gender", labels=labels).transform(scored)
    scored = probability_columns(scored, labels)
    return scored.select(*carried, status.alias("status"),
                         *[F.when(ok, F.col(c)).alias(c) for c in ("predicted_gender", "confidence", "probabilities")],
                         F.when(ok, F.lit(version)).alias("model_version"), "input_received")


# SCR3 — one answer per hotel request: its recommendations as an array, or why there are none
def recommendation_responses(routed: DataFrame, recommend: Callable[[DataFrame], DataFrame], version: str = MODEL_VERSION) -> DataFrame:
    recs = recommend(routed.where(F.col("status") == "valid").select("request_id", "req.*"))
    fields = [c for c in recs.columns if c != "request_id"]
    lists = recs.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("recommendations"))
    out = routed.select("request_id", F.col("status").alias("_routed"), "message", F.col("req").alias("input_received")).join(lists, "request_id", "left")
    ok = F.col("_routed") == "valid"
    n = F.coalesce(F.size("recommendations"), F.lit(0))
    return out.select(
        "request_id", F.when(ok & (n > 0), "success").when(ok, "no_match").otherwise(F.col("_routed")).alias("status"), "message",
        F.when(F.col("recommendations").isNull(), 0).otherwise(n).alias("n_results"), "recommendations",
        F.when(ok, F.lit(version)).alias("model_version"), "input_received")


# SCR5 — primary result, else the fallback model's result; requests that may not be scored get neither
def with_fallback(primary: Column, fallback: Column, ok: Column) -> dict[str, Column]:
    first = ok & primary.isNotNull()
    second = ok & primary.isNull() & fallback.isNotNull()
    return {"predicted_price": F.when(first, primary).when(second, fallback),
            "source": F.when(first, "primary").when(second, "fallback"),
            "model_version": F.when(first, MODEL_VERSION).when(second, FALLBACK_VERSION)}


# Each request is answered once
DELIVERY_WINDOW = "24 hours"


def request_key(requests: DataFrame, key: str = "request_id", body: str = "body") -> Column:
    """What makes two deliveries the same request: its id, its text and the source that gave it. Requests that share
    an id but not the text are different ones."""
    own = F.concat(F.lit("id:"), F.col(key).cast("string")) if key in requests.columns else F.lit(None).cast("string")
    text = F.sha2(F.coalesce(body, F.lit("")), 256)
    origin = [F.coalesce(F.col("source"), F.lit(""))] if "source" in requests.columns else []
    return F.concat_ws("\n", *origin, F.coalesce(own, F.lit("")), text)


def once(requests: DataFrame, key: str = "request_id", body: str = "body", window: str = DELIVERY_WINDOW) -> DataFrame:
    """Drop requests that were delivered before.

    In a stream the keys seen within ``window`` of their arrival are kept as state in the checkpoint, spread over the
    shuffle partitions by key, so a second delivery is dropped in a later micro-batch and after a restart, too. Time is
    the arrival of the micro-batch (the same when it runs again), so no request is ever late, and state that is older
    than the window is dropped. In a batch the delivery whose other columns are smallest stays.
    """
    keyed = requests.withColumn("_request", request_key(requests, key, body))
    if requests.isStreaming:
        return (keyed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", window)
                .dropDuplicatesWithinWatermark(["_request"]).drop("_request", "_arrived"))
    rest = [c for c in requests.columns if c != body]
    first = F.min_by(F.struct(*requests.columns), F.struct(F.coalesce(body, F.lit("")), *[F.col(c) for c in rest]))
    return keyed.groupBy("_request").agg(first.alias("r")).select("r.*")


# Streaming wrapper: file source -> the same transform -> file sink
def run_stream(spark: SparkSession, transform: Callable[[DataFrame], DataFrame], schema: T.StructType,
               source_dir: str, sink_dir: str, checkpoint_dir: str, fmt: str = "json") -> None:
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = (transform(stream).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start(sink_dir))
    q.awaitTermination()


def run_stream_batches(spark: SparkSession, batch_fn: Callable[[DataFrame], DataFrame], schema: T.StructType,
                       source_dir: str, sink_dir: str, checkpoint_dir: str, fmt: str = "json") -> None:
    """For per-request ranking (SCR3): each micro-batch is scored as a batch and written to its epoch's own
    folder, so an epoch that runs again replaces what it wrote."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch_fn(batch).write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")

    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
