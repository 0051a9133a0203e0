"""Fit-on-train / apply-anywhere feature steps in SQL form (FEA1-3, 6, 7, 9).

A fitted step is a handful of numbers or a small mapping table. Numbers are
fetched with one aggregate (a single row) and baked into expressions, so
applying the step is a projection inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import rank_within
from ..session import ensure_checkpoint_dir, materialize


# FEA1 — exact median (even counts average the middle pair); approximate on request.
# Counts in BINS equal-width bins narrow the range around the middle until at most
# EXACT_ROWS values are left in it; only their value counts reach the driver. What a
# task or the driver holds is bounded by these two numbers, however many rows or
# distinct values there are.
BINS = 4096
EXACT_ROWS = 10_000


def fit_medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, float | None]:
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in cols]).first()
        return {c: (None if row[c] is None else float(row[c])) for c in cols}
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    first = x.agg(*[f(c).alias(f"{c}__{k}") for c in cols for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # per column: value range around the middle, values below it, values in it, and the middle ranks
    ranges = {c: [first[f"{c}__lo"], first[f"{c}__hi"], 0, first[f"{c}__n"]] for c in cols if first[f"{c}__n"]}
    ranks = {c: ((first[f"{c}__n"] - 1) // 2, first[f"{c}__n"] // 2) for c in ranges}

    def inside(names: Sequence[str], value) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("c"), F.col(c).alias("x"), value(c).alias("v")) for c in names]
        keep = F.lit(False)
        for c in names:
            keep = keep | ((F.col("c") == c) & F.col("x").between(*ranges[c][:2]))
        return x.select(F.inline(F.array(*parts))).where(F.col("x").isNotNull() & keep)

    while wide := [c for c, (lo, hi, _, n) in ranges.items() if n > EXACT_ROWS and lo < hi]:
        def bin_of(c: str) -> Column:
            lo, hi = ranges[c][:2]
            at = F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))  # values outside are dropped after this
            return F.least(F.lit(BINS - 1), F.floor((at - lo) / F.lit(hi - lo) * BINS).cast("int"))

        bins = (inside(wide, bin_of).groupBy("c", "v")
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("c", "v").collect())
        for c in wide:
            below, kept = ranges[c][2], []
            for b in (b for b in bins if b["c"] == c):
                if below + b["n"] > ranks[c][0] and below <= ranks[c][1]:
                    kept.append((b, below))
                below += b["n"]
            ranges[c] = [kept[0][0]["lo"], kept[-1][0]["hi"], kept[0][1], sum(b["n"] for b, _ in kept)]
    out: dict[str, float | None] = {c: None for c in cols}
    small = {c: r for c, r in ranges.items() if r[0] < r[1]}
    values = inside(list(small), lambda c: F.lit(0)).groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("c", "x").collect() if small else []
    for c, (lo, hi, below, _) in ranges.items():
        pair = [lo, lo] if lo == hi else []
        if c in small:
            at = below
            for r in (r for r in values if r["c"] == c):
                pair += [r["x"] for k in ranks[c] if at <= k < at + r["n"]]
                at += r["n"]
        out[c] = float((pair[0] + pair[1]) / 2)
    return out


# FEA2 — most frequent value, smallest on ties: counted per value with map-side combine, so
# no aggregate buffer grows with the distinct values.
def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.select(*cols).schema.fields}
    parts = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"),
                      (F.col(c).cast("double") if isinstance(types[c], T.NumericType) else F.lit(None).cast("double")).alias("o")) for c in cols]
    counts = (df.select(F.inline(F.array(*parts))).where(F.col("v").isNotNull())
              .groupBy("c", "v", "o").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "o", "v")).alias("v"))
    found = {r["c"]: r["v"] for r in best.collect()}
    whole = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)

    def back(c: str) -> object:
        v = found.get(c)
        if v is None or isinstance(types[c], T.StringType):
            return v
        return int(v) if isinstance(types[c], whole) else float(v) if isinstance(types[c], T.NumericType) else v

    return {c: back(c) for c in cols}


def impute(df: DataFrame, values: dict[str, object], cast_double: bool = False) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if cast_double else F.col(c), F.lit(v))
                           for c, v in values.items() if v is not None})


# FEA3 — standard scaling with the population deviation; constant column -> 0
def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def standardize(c: str | Column, mean: float, std: float) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.lit(0.0) * x if not std else (x - F.lit(mean)) / F.lit(std)


# FEA9 — min-max scaling; a constant column maps to x - min (so 0 on the fitted data)
def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.min(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}__lo"),
                 F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}__hi")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in cols}


def minmax(c: str | Column, lo: float, hi: float) -> Column:
    x = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))
    rng = hi - lo
    return (x - F.lit(lo)) / F.lit(rng if rng else 1.0)


# FEA6 — label encoding in sorted order; unseen or null -> 0
def fit_label_encoders(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Per column a mapping table (value, code) with codes 0..k-1 in ascending value order.

    All columns are fitted in one pass over ``df``; the mappings are written once to
    the checkpoint folder (they are the encoders' state), and every join reads them."""
    parts = [F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols]
    values = df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull()).distinct()
    ensure_checkpoint_dir(df.sparkSession)
    coded = materialize(rank_within(materialize(values), "col", ["value"], "code", "_n")
                        .select("col", "value", F.col("code").cast("int").alias("code")))
    return {c: coded.where(F.col("col") == c).select("value", "code") for c in cols}


def fit_label_encoder(df: DataFrame, col: str) -> DataFrame:
    return fit_label_encoders(df, [col])[col]


def label_encode(df: DataFrame, col: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    m = mapping.select(F.col("value").alias(col), F.col("code").alias(out or f"{col}_enc"))
    return df.join(m, col, "left").withColumn(out or f"{col}_enc", F.coalesce(F.col(out or f"{col}_enc"), F.lit(0)))


# FEA7 — inverse decoding
def label_decode(df: DataFrame, code_col: str, mapping: DataFrame, out: str) -> DataFrame:
    m = mapping.select(F.col("code").alias(code_col), F.col("value").alias(out))
    return df.join(m, code_col, "left")
