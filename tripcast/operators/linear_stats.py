"""Linear regression from mergeable statistics (MDL1): new data is read alone, old data never again.

A part of the data (here a year) is summed up in one small table: for every pair of
terms the sum of their products. Terms are the constant, the label, each numeric
column and each level of each categorical column that a row has. Such tables add up:
the statistics of several parts are the sum of theirs, and the normal equations of the
whole follow from them. Sums are decimals, so they do not depend on order or grouping:
a merged fit equals a full fit to the last bit.

Scale: a row holds a handful of terms, their products are summed before the shuffle,
and a part's table has at most terms x terms rows, whatever the number of data rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import literal_frame

CONSTANT, LABEL = "1", "y"
#: Numbers enter with six digits behind the point; sums hold 26 digits before it. Columns that depend on one another up to such
#: rounding are told from noise by the ridge (of the scaled equations).
NUMBER, SUM = "decimal(18,6)", "decimal(38,12)"
#: Terms that the driver solves for at most; the equations grow with the square of their number.
MAX_TERMS = 2_000
RIDGE = 1e-9


def _terms(numeric: Sequence[str], categorical: Sequence[str], label: str | None = None) -> Column:
    """array<struct(term, value)> of a row. A missing number is 0 with a level of its own; a missing level is one, too."""
    def entry(name: Column | str, value: Column | int) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("term"), (F.lit(value) if isinstance(value, int) else value).cast(NUMBER).alias("value"))

    parts = [entry(CONSTANT, 1)]
    parts += [entry(LABEL, F.col(label))] if label else []
    parts += [entry(f"n:{c}", F.coalesce(F.col(c).cast(NUMBER), F.lit(0))) for c in numeric]
    parts += [entry(f"m:{c}", F.when(F.col(c).isNull(), 1).otherwise(0)) for c in numeric]
    parts += [entry(F.concat(F.lit(f"c:{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))), 1) for c in categorical]
    return F.filter(F.array(*parts), lambda x: x["value"] != 0)


def statistics(df: DataFrame, part: str, numeric: Sequence[str], categorical: Sequence[str], label: str = "label") -> DataFrame:
    """(part, a, b, s): sums of products of every pair of terms (a <= b) by part. Rows without a label are left out."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(part).alias("part"), _terms(numeric, categorical, label).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x: F.transform(F.filter("t", lambda y: y["term"] >= x["term"]), lambda y: F.struct(
        x["term"].alias("a"), y["term"].alias("b"), (x["value"] * y["value"]).alias("p")))))
    return rows.select("part", F.inline(pairs)).groupBy("part", "a", "b").agg(F.sum("p").cast(SUM).alias("s"))


def refresh(stats: DataFrame, path: str) -> None:
    """Write the statistics of the parts in ``stats``; the folders of other parts are left as they are."""
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merge(stats: DataFrame) -> DataFrame:
    """(a, b, s) of all parts together."""
    return stats.groupBy("a", "b").agg(F.sum("s").cast(SUM).alias("s"))


@dataclass
class LinearModel:
    numeric: list[str]
    categorical: list[str]
    weights: dict[str, float]
    n_rows: int

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Unknown levels count as the reference level."""
        spark = df.sparkSession
        rows = literal_frame(spark, sorted(self.weights.items()), ["term", "weight"])
        table = rows.agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_w"))  # MAX_TERMS entries at most
        value = F.aggregate(_terms(self.numeric, self.categorical), F.lit(0.0),
                            lambda acc, x: acc + x["value"].cast("double") * F.coalesce(F.try_element_at("_w", x["term"]), F.lit(0.0)))
        return df.crossJoin(F.broadcast(table)).withColumn(name, value).drop("_w")


def solve(merged: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ridge: float = RIDGE) -> LinearModel:
    """Least squares from merged statistics. Of each categorical column the first level is the reference."""
    terms = sorted(r["a"] for r in merged.where(F.col("a") == F.col("b")).select("a").limit(MAX_TERMS + 1).collect())
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: encode fewer levels")
    if CONSTANT not in terms:
        raise ValueError("no labelled rows")
    first = {}
    for t in terms:
        if t.startswith("c:"):
            first.setdefault(t.split("=", 1)[0], t)
    use = [t for t in terms if t != LABEL and t not in first.values()]
    place = {t: i for i, t in enumerate(use)}
    g, xy, n = np.zeros((len(use), len(use))), np.zeros(len(use)), 0
    for a, b, s in merged.collect():  # terms x terms rows at most
        if a == b == CONSTANT:
            n = int(s)
        if a in place and b in place:
            g[place[a], place[b]] = g[place[b], place[a]] = float(s)
        elif LABEL in (a, b) and (other := b if a == LABEL else a) in place:
            xy[place[other]] = float(s)
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    w = np.linalg.solve(g / np.outer(scale, scale) + ridge * np.eye(len(use)), xy / scale) / scale
    return LinearModel(list(numeric), list(categorical), dict(zip(use, w.tolist())), n)
