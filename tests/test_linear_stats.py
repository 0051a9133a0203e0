"""Mergeable regression statistics: merged equals full, a refresh reads and writes one part only."""

import os

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripcast.operators import linear_stats as LS
from tripcast.plans import catalog as C

NUM, CAT = ["distance", "time"], ["flightType", "agency"]


def frame(spark):
    return C._f(spark, SF_SMALL).select("travelCode", F.year("date").alias("year"), F.col("price").alias("label"), *NUM, *CAT)


def test_merged_fit_equals_a_full_fit(spark):
    df = frame(spark)
    by_year = LS.solve(LS.merge(LS.statistics(df, "year", NUM, CAT)), NUM, CAT)
    whole = LS.solve(LS.merge(LS.statistics(df.repartition(7).withColumn("all", F.lit(0)), "all", NUM, CAT)), NUM, CAT)
    assert by_year.n_rows == whole.n_rows == df.where("label is not null").count()
    assert by_year.weights == whole.weights  # to the last bit
    # the same as least squares over the rows themselves
    rows = df.where("label is not null").toPandas()
    x = [np.ones(len(rows))] + [rows[c].fillna(0).astype(float).to_numpy() for c in NUM]
    x += [rows[c].isna().astype(float).to_numpy() for c in NUM]
    for c in CAT:
        levels = sorted(rows[c].fillna("").unique())
        for v in levels[1:]:
            x.append((rows[c].fillna("") == v).astype(float).to_numpy())
    w, *_ = np.linalg.lstsq(np.stack(x, 1), rows["label"].astype(float).to_numpy(), rcond=None)
    fitted = np.stack(x, 1) @ w
    got = by_year.predict(df.where("label is not null")).select("travelCode", "prediction").toPandas().set_index("travelCode")["prediction"]
    assert np.allclose(got.loc[rows["travelCode"]].to_numpy(), fitted, rtol=1e-6, atol=1e-3)


def test_refresh_of_one_part_leaves_the_others(spark, tmp_path):
    df = frame(spark)
    path = str(tmp_path / "stats")
    LS.refresh(LS.statistics(df, "year", NUM, CAT), path)
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    year = df.agg(F.max("year")).first()[0]
    more = df.where(F.col("year") == year).unionByName(df.where(F.col("year") == year).withColumn("label", F.col("label") + 10))
    LS.refresh(LS.statistics(more, "year", NUM, CAT), path)
    after = {f: (d, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    changed = {d for f, (d, t) in after.items() if before.get(f) != t}
    assert {os.path.basename(d) for d in changed} == {f"part={year}"}
    merged = LS.solve(LS.merge(spark.read.parquet(path)), NUM, CAT)
    full = LS.solve(LS.merge(LS.statistics(df.where(~F.col("year").eqNullSafe(year)).unionByName(more), "year", NUM, CAT)), NUM, CAT)
    assert merged.weights == full.weights


def test_nulls_unknown_levels_and_empty_input(spark):
    rows = [(1, 2000, 10.0, 1.0, "a"), (2, 2000, 20.0, 2.0, "b"), (3, 2001, 30.0, None, None), (4, 2001, None, 1.0, "a"), (5, 2001, 11.0, 1.5, "a"), (6, None, 19.0, 1.0, "b")]
    df = spark.createDataFrame(rows, "k int, year int, label double, x double, c string")
    m = LS.solve(LS.merge(LS.statistics(df, "year", ["x"], ["c"])), ["x"], ["c"])
    assert m.n_rows == 5
    new = spark.createDataFrame([(1, None, "zz"), (2, 3.0, "a")], "k int, x double, c string")
    got = {r["k"]: r["prediction"] for r in m.predict(new).collect()}
    assert set(got) == {1, 2} and all(np.isfinite(v) for v in got.values())
    try:
        LS.solve(LS.merge(LS.statistics(df.where("false"), "year", ["x"], ["c"])), ["x"], ["c"])
        raise AssertionError("an empty table has no fit")
    except ValueError:
        pass
