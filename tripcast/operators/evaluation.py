"""Evaluation in SQL form (EVA1, EVA2, EVA4) and deterministic reference predictors.

Metrics are one aggregate over the prediction table (map-side partial
aggregation, one row out). The classification metrics go through the
confusion table, whose size is bounded by (number of classes)^2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# EVA1 — RMSE, MAE, R^2 (R^2 from the population variance of the label)
def regression_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return preds.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(F.lit(1)))).alias("r2"),
    )


# EVA2 — accuracy and support-weighted precision / recall / F1, zero division -> 0
def classification_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    conf = preds.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    truth = conf.groupBy(F.col("y").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = truth.join(predicted, "cls", "full").na.fill(0, ["support", "tp", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.withColumns({"prec": prec, "rec": rec})
    f1 = F.coalesce(F.try_divide(F.col("prec") * F.col("rec") * 2, F.col("prec") + F.col("rec")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    n = F.sum("support")
    return per.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


# Deterministic predictors (so that DuckDB can check the metric jobs). The training rows are
# reduced once to sums and counts per group; the overall value comes from those few rows.
def group_mean_model(train: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, Column]:
    groups = train.groupBy(*keys).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    overall = groups.agg(F.sum("_s") / F.sum("_n"))
    return groups.select(*keys, (F.col("_s") / F.col("_n")).alias("prediction")), overall.scalar()


def apply_group_mean(test: DataFrame, means: DataFrame, overall: Column, keys: Sequence[str]) -> DataFrame:
    return (test.join(means, list(keys), "left")
            .withColumn("prediction", F.coalesce("prediction", overall)))


def majority_model(train: DataFrame, key: str, label: str) -> tuple[DataFrame, Column]:
    """Most frequent label per key value (smallest label on ties) and overall."""
    counts = train.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("prediction"))
    totals = counts.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum("n").alias("n"))
    return best, totals.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).scalar()


# EVA4 — keep the candidate only when strictly better than the baseline
def select_best(runs: DataFrame, metric: str = "metric", model: str = "model", baseline: str = "is_baseline") -> DataFrame:
    return runs.agg(
        F.max_by(model, F.struct(F.round(metric, 9), F.col(baseline))).alias("selected_model"),
        F.max(F.round(metric, 9)).alias("selected_metric"),
    )
