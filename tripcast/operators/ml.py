"""Spark ML: preprocessing, the six models, selection, persistence and run logging.

FEA4/FEA5: numeric columns are median-imputed and standard-scaled
(population deviation) by a ``SQLTransformer`` holding fitted literals, so the
exact median and the divisor-n deviation live inside the saved
``PipelineModel``. Categorical columns are mode-imputed, indexed
alphabetically with ``handleInvalid="keep"`` and one-hot encoded with
``dropLast=True``: the dropped last slot is the unknown bucket, so an unseen
or null level becomes all zeros while every known level keeps its slot.
Feature kinds come from the schema (string -> categorical, numeric -> numeric).

Scale notes: every fit statistic is one aggregate; tree learners and
logistic regression are Spark's distributed implementations. ``StringIndexer``
collects the distinct labels of each categorical column to the driver, which
is fine for the low-cardinality columns used here.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import features as FE
from . import evaluation as EV
from . import sampling as S

FEATURES_COL = "features"
# Partitions of a training frame. Tree learners draw their row samples per partition, so the number is
# part of the model: it follows from the number of training rows and trees alone, not from files or
# cores. TRAIN_PARTITIONS is the least; beyond it a partition holds PARTITION_WORK rows times trees, so
# a task's work stays the same as the data grows (rows are dealt by key, so partitions stay even).
TRAIN_PARTITIONS = 8
PARTITION_WORK = 12_500_000
# A learner that is no forest is dealt like one of this many trees.
DEFAULT_TREES = 50
# A trace of ridge: all one-hot levels plus an intercept are linearly dependent, so the plain normal
# equations are singular. It moves R2 by less than 1e-10.
RIDGE = 1e-6


def feature_kinds(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split ``cols`` by schema: strings are categorical, numbers are numeric."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cat = [c for c in cols if isinstance(types[c], T.StringType)]
    num = [c for c in cols if isinstance(types[c], T.NumericType)]
    return num, cat


def _q(c: str) -> str:
    return f"`{c}`"


# FEA5 — fit the column-wise preprocessing on the training frame
def build_preprocessor(train: DataFrame, cols: Sequence[str]) -> list:
    num, cat = feature_kinds(train, cols)
    # medians and modes by bounded value counts, then mean and population std of the imputed values
    med = {c: 0.0 if m is None else m for c, m in FE.fit_medians(train, num).items()}
    modes = FE.fit_modes(train, cat)
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in num]) if num else None
    std = FE.fit_standard(filled, num) if num else {}
    exprs = []
    for c in num:
        mean, sd = std[c]
        x = f"coalesce(CAST({_q(c)} AS DOUBLE), {med[c]!r})"
        exprs.append(f"({x} - {mean!r}) / {sd!r} AS {_q(c + '__num')}" if sd else f"0.0 AS {_q(c + '__num')}")
    for c in cat:
        mode = modes[c]
        lit = "NULL" if mode is None else "'" + str(mode).replace("'", "''") + "'"
        exprs.append(f"coalesce({_q(c)}, {lit}) AS {_q(c + '__cat')}")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if cat:
        # one indexer for all categorical columns: their labels are collected in a single pass
        stages.append(StringIndexer(inputCols=[c + "__cat" for c in cat], outputCols=[c + "__idx" for c in cat],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[c + "__idx" for c in cat], outputCols=[c + "__ohe" for c in cat],
                                    dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[c + "__num" for c in num] + [c + "__ohe" for c in cat],
                                  outputCol=FEATURES_COL, handleInvalid="keep"))
    return stages


# MDL1-6 — model factories with the source application's hyper-parameters
def linear_regression(label: str = "label"):
    return LinearRegression(featuresCol=FEATURES_COL, labelCol=label, regParam=RIDGE, solver="normal")


def forest_regressor(label: str = "label", trees: int = 50, depth: int = 10):
    return RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=label, numTrees=trees, maxDepth=depth,
                                 featureSubsetStrategy="all", maxBins=256, seed=42)


def logistic_regression(n_train: int, label: str = "label_idx", weight: str = "class_weight"):
    return LogisticRegression(featuresCol=FEATURES_COL, labelCol=label, weightCol=weight, maxIter=1000,
                              regParam=1.0 / max(1, n_train), elasticNetParam=0.0, standardization=False,
                              family="multinomial")


def forest_classifier(label: str = "label_idx", weight: str | None = "class_weight", trees: int = 500,
                      depth: int = 30, min_leaf: int = 2, seed: int = 42):
    kw = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol=FEATURES_COL, labelCol=label, numTrees=trees, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed, **kw)


def gbt_regressor(label: str = "label"):
    return GBTRegressor(featuresCol=FEATURES_COL, labelCol=label, maxIter=60, maxDepth=5, stepSize=0.15, seed=42)


# Minimum training sizes of the source application (MDL5: > 500 rows, MDL6: > 50 rows).
MIN_ROWS_GBT = 500
MIN_ROWS_NAME_FOREST = 50


def require_rows(df: DataFrame, more_than: int, what: str) -> None:
    """Bounded count: fail clearly when the training frame is too small."""
    if df.limit(more_than + 1).count() <= more_than:
        raise ValueError(f"{what} needs more than {more_than} training rows")


# Shared feature function for flights: identical in training and scoring
FLIGHT_CATEGORICAL = ["flightType", "agency", "from", "to"]
FLIGHT_NUMERIC = ["distance", "time", "day", "month", "weekday"]
# The order in which a forest reads a partition's flights: flights of one class and route stand together,
# then those of like dates. It bears on speed alone (6 times sf0.1: 372 CPU seconds; in the columns' order 490).
FLIGHT_ORDER = ["flightType", "from", "to", "agency", "month", "weekday", "day"]


def flight_features(flights_typed: DataFrame) -> DataFrame:
    """Training frame: id columns dropped, calendar codes, label = price (USD)."""
    cal = C.calendar_codes("date")
    return flights_typed.select("travelCode", *FLIGHT_CATEGORICAL, "distance", "time",
                                *[v.alias(k) for k, v in cal.items()], F.col("price").alias("label"))


USER_FEATURES = ["company", "first_name", "first_letter", "last_letter", "name_length", "age"]


def user_features(users: DataFrame) -> DataFrame:
    """Training frame for the classifier: name features (PRJ7), label = gender."""
    f = C.name_features_training("name")
    return users.select("code", "company", *[v.alias(k) for k, v in f.items()], "age", F.col("gender").alias("label"))


def train_partitions(n_rows: int, trees: int = DEFAULT_TREES) -> int:
    """Partitions of ``n_rows`` training rows for a learner of ``trees`` trees."""
    return max(TRAIN_PARTITIONS, -(-n_rows * trees // PARTITION_WORK))


def dealt(train: DataFrame, key: str, estimator=None, order: Sequence[str] = ()) -> DataFrame:
    """The rows by key hash in sorted partitions whose number follows from the data and the learner: equal data
    gives an equal model on any cluster and after any retry.

    For a forest, a partition's rows are sorted by the feature columns ``order`` before the key. Like rows reach the
    same node of a tree, and a forest's deep levels hold more than 100 MB of node statistics in a task: in key order
    nearly every row's updates miss the processor's caches, in feature order they stay in them."""
    forest = hasattr(estimator, "getNumTrees")
    rows = train.repartition(train_partitions(train.count(), estimator.getNumTrees() if forest else DEFAULT_TREES), key)
    return rows.sortWithinPartitions(*(order if forest else ()), key)


def fit_dealt(train: DataFrame, key: str, estimator, pipeline=None, order: Sequence[str] = ()):
    """Fit ``pipeline`` (or the bare estimator) on the dealt rows. They are persisted for the duration of the fit, as
    learners read them several times; a lost executor only means recomputing its blocks from lineage."""
    train = dealt(train, key, estimator, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return (pipeline or (lambda rows: estimator))(train).fit(train)
    finally:
        train.unpersist()


def fit_model(train: DataFrame, cols: Sequence[str], estimator, head: Sequence = (), key: str = "travelCode",
              order: Sequence[str] = ()) -> PipelineModel:
    """Fit preprocessing + estimator; a forest reads its rows in ``order`` (else that of ``cols``)."""
    return fit_dealt(train, key, estimator, lambda rows: Pipeline(stages=list(head) + build_preprocessor(rows, cols) + [estimator]), order or cols)


# EVA5 — train, evaluate, log
def train_regressor(train: DataFrame, test: DataFrame, estimator, cols: Sequence[str],
                    order: Sequence[str] = ()) -> tuple[PipelineModel, dict]:
    model = fit_model(train, cols, estimator, order=order)
    m = EV.regression_metrics(model.transform(test)).first().asDict()
    return model, m


def train_classifier(train: DataFrame, test: DataFrame, estimator, cols: Sequence[str],
                     label: str = "label", key: str = "code") -> tuple[PipelineModel, dict]:
    weights = S.class_weights(train, label)
    tr = train.join(weights.select(label, "class_weight"), label)
    label_idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc")
    to_label = IndexToString(inputCol="prediction", outputCol="predicted_label")
    model = fit_model(tr, cols, estimator, head=[label_idx], key=key)
    to_label.setLabels(model.stages[0].labels)
    preds = to_label.transform(model.transform(test.where(F.col(label).isNotNull())))
    m = EV.classification_metrics(preds, label, "predicted_label").first().asDict()
    return model, m


# MDL8 — importances summed back to source columns
def feature_importances(spark: SparkSession, model: PipelineModel, data: DataFrame) -> DataFrame:
    est = model.stages[-1]
    vec_field = model.transform(data.limit(1)).schema[FEATURES_COL]
    attrs = vec_field.metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a["name"]
    imp = est.featureImportances.toArray().tolist()
    rows = []
    for i, v in enumerate(imp):
        n = names.get(i, f"f{i}")
        src = n.split("__")[0]
        rows.append((src, float(v)))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"))


def importances(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    """(column, importance) of a fitted tree model over plain columns, largest first."""
    found = zip(columns, model.featureImportances.toArray().tolist())
    return sorted(found, key=lambda x: (-x[1], x[0]))


# MDL9 — probabilities, label and confidence
def probability_columns(preds: DataFrame, labels: Sequence[str]) -> DataFrame:
    probs = vector_to_array("probability")
    keys = F.array(*[F.lit(x) for x in labels])
    return preds.withColumns({
        "confidence": F.round(F.array_max(probs), 4),
        "probabilities": F.map_from_arrays(keys, F.transform(probs, lambda p: F.round(p, 4))),
    })


# SNK1 / SNK2
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# SNK3 — append-only run log
RUNS_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def model_params(model: PipelineModel) -> dict[str, str]:
    est = model.stages[-1]
    return {p.name: json.dumps(v, default=str) for p, v in est.extractParamMap().items()}


def log_run(spark: SparkSession, runs_path: str, experiment: str, run_name: str,
            params: dict[str, str], metrics: dict[str, float]) -> DataFrame:
    row = [(experiment, run_name, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
            {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items() if v is not None})]
    df = spark.createDataFrame(row, RUNS_SCHEMA)
    df.write.mode("append").parquet(runs_path)
    return df


# EVA4 over logged runs: candidate only when strictly better than the baseline
def best_run(runs: DataFrame, metric: str, baseline_run: str) -> DataFrame:
    r = runs.select("run_name", F.col("metrics")[metric].alias("metric"),
                    (F.col("run_name") == baseline_run).alias("is_baseline"))
    return EV.select_best(r, "metric", "run_name", "is_baseline")
