"""Invariants for the Spark ML jobs (rows-only operators)."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tripcast.operators import ml as ML
from tripcast.operators import sampling as S
from tripcast.plans import catalog as Q
from conftest import SF_MID, SF_SMALL


def test_linear_regression_r2(spark):
    tr, te = Q._flight_frames(spark, SF_SMALL)
    model, m = ML.train_regressor(tr, te, ML.linear_regression(), Q.FLIGHT_COLS)
    assert m["r2"] > 0.9


def test_gbt_r2_and_importances(spark):
    model, _, te = Q._fit_gbt(spark, SF_SMALL)
    from tripcast.operators.evaluation import regression_metrics
    assert regression_metrics(model.transform(te)).first()["r2"] > 0.9
    assert abs(sum(model.featureImportances.toArray()) - 1.0) < 1e-9


def test_equal_data_gives_an_equal_model_on_any_partitioning(spark):
    tr, te = Q._flight_frames(spark, SF_SMALL)
    small = ML.forest_regressor(trees=5, depth=5)
    a = ML.fit_model(tr.repartition(2), Q.FLIGHT_COLS, small).transform(te).select("travelCode", "prediction")
    b = ML.fit_model(tr.repartition(13), Q.FLIGHT_COLS, small).transform(te).select("travelCode", "prediction")
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_medians_and_modes_are_exact(spark, monkeypatch):
    import statistics

    import numpy as np

    from tripcast.functions import features as FE

    rng = np.random.default_rng(3)
    n = 20_001
    cols = {"u": rng.random(n), "heavy": np.exp(rng.normal(0, 9, n)), "same": np.full(n, 2.5), "ints": rng.integers(0, 7, n).astype(float)}
    rows = [tuple(None if (i + k) % 11 == 0 else float(v[i]) for k, v in enumerate(cols.values())) + ("ab"[i % 2] if i % 5 else None, i % 4)
            for i in range(n)]
    df = spark.createDataFrame(rows, "u double, heavy double, same double, ints double, s string, k int")
    monkeypatch.setattr(FE, "EXACT_ROWS", 50)
    got = FE.fit_medians(df, list(cols))
    for j, c in enumerate(cols):
        assert got[c] == statistics.median(r[j] for r in rows if r[j] is not None)
    for c, j in (("s", 4), ("k", 5)):
        values = [r[j] for r in rows if r[j] is not None]
        assert FE.fit_modes(df, [c])[c] == min(set(values), key=lambda v: (-values.count(v), v))
    assert FE.fit_medians(df.limit(0), ["u"]) == {"u": None} and FE.fit_modes(df.limit(0), ["s"]) == {"s": None}


def test_listed_terms_are_counted_per_document(spark):
    from tripcast.functions import text as TX

    docs = spark.createDataFrame([(1, "the cat the dog the"), (2, ""), (3, None), (4, "a b"), (5, "one dog")], "id int, t string")
    terms = TX.top_terms(docs, "id", "t", 2)
    assert [r["term"] for r in terms.collect()] == ["the", "dog"]
    got = {(r["doc_id"], r["term"]): r["tf"] for r in TX.term_counts(docs, "id", "t", terms).collect()}
    assert got == {(1, "the"): 3, (1, "dog"): 1, (5, "dog"): 1}


def test_classifier_f1_and_probabilities(spark):
    tr, te = Q._user_frames(spark, SF_MID)
    model, m = ML.train_classifier(tr, te, ML.logistic_regression(tr.count()), ML.USER_FEATURES)
    assert m["f1"] > 0.7
    probs = model.transform(te).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in probs.collect())


def test_forest_classifier_small(spark):
    tr, te = Q._user_frames(spark, SF_MID)
    model, m = ML.train_classifier(tr, te, ML.forest_classifier(trees=20), ML.USER_FEATURES)
    assert m["f1"] > 0.7


def test_unseen_category_is_zero_vector(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "cat string, x double")
    stages = ML.build_preprocessor(train, ["cat", "x"])
    model = Pipeline(stages=stages).fit(train)
    test = spark.createDataFrame([("b", 2.0), ("zzz", 2.0), (None, 2.0)], "cat string, x double")
    vecs = [r["v"] for r in model.transform(test).select(vector_to_array("cat__ohe").alias("v")).collect()]
    assert vecs[0] == [0.0, 1.0, 0.0]  # a, b, c all kept
    assert vecs[1] == [0.0, 0.0, 0.0]  # unseen -> zeros
    assert vecs[2] == [1.0, 0.0, 0.0]  # null -> mode ('a', smallest on ties)


def test_save_load_equal_predictions(spark, tmp_path):
    tr, te = Q._flight_frames(spark, SF_SMALL)
    model, _ = ML.train_regressor(tr, te, ML.linear_regression(), Q.FLIGHT_COLS)
    path = ML.save_model(model, str(tmp_path / "m"))
    a = model.transform(te).select("travelCode", "prediction")
    b = ML.load_model(path).transform(te).select("travelCode", "prediction")
    assert a.exceptAll(b).count() == 0


def test_run_log_and_selection(spark, tmp_path):
    runs = str(tmp_path / "runs")
    ML.log_run(spark, runs, "exp", "base", {"p": "1"}, {"r2": 0.5})
    ML.log_run(spark, runs, "exp", "cand", {"p": "2"}, {"r2": 0.5})
    df = spark.read.parquet(runs)
    assert ML.best_run(df, "r2", "base").first()["selected_model"] == "base"  # ties keep the baseline
    ML.log_run(spark, runs, "exp", "cand2", {"p": "3"}, {"r2": 0.6})
    assert ML.best_run(spark.read.parquet(runs), "r2", "base").first()["selected_model"] == "cand2"


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    w = {r["y"]: r["class_weight"] for r in S.class_weights(df, "y").collect()}
    assert abs(w["a"] - 4 / 6) < 1e-12 and abs(w["b"] - 2.0) < 1e-12


def test_importances_summed_to_source_columns(spark):
    tr, te = Q._flight_frames(spark, SF_SMALL)
    model = ML.fit_model(tr, Q.FLIGHT_COLS, ML.forest_regressor(trees=10, depth=5))
    imp = {r["feature"]: r["importance"] for r in ML.feature_importances(spark, model, te).collect()}
    assert set(imp) <= set(Q.FLIGHT_COLS) and abs(sum(imp.values()) - 1.0) < 1e-9
    assert max(imp, key=imp.get) in ("flightType", "distance", "time")


def test_forest_regressor_r2(spark):
    tr, te = Q._flight_frames(spark, SF_SMALL)
    model, m = ML.train_regressor(tr, te, ML.forest_regressor(trees=20), Q.FLIGHT_COLS)
    assert m["r2"] > 0.9


def test_gender_forest_f1_and_probabilities(spark):
    df, _ = Q._gender_forest(spark, SF_MID)
    from tripcast.operators.evaluation import classification_metrics
    assert classification_metrics(df, "gender", "predicted_gender").first()["f1"] > 0.7
    sums = df.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r["s"] - 1.0) < 2e-3 for r in sums.collect())  # 4-decimal rounding per class
    assert df.where(F.col("confidence") < 1.0 / 3 - 1e-3).count() == 0


def test_minimum_training_rows(spark):
    import pytest
    small = spark.range(0, 40).withColumnRenamed("id", "x")
    with pytest.raises(ValueError):
        ML.require_rows(small, ML.MIN_ROWS_NAME_FOREST, "test")
    ML.require_rows(spark.range(0, 51), ML.MIN_ROWS_NAME_FOREST, "test")


def test_training_partitions_follow_rows_and_trees():
    assert ML.train_partitions(0) == ML.train_partitions(720_000) == ML.TRAIN_PARTITIONS
    assert ML.train_partitions(7_200_000) == 29 and ML.train_partitions(43_200_000) == 173
    assert ML.train_partitions(720_000, ML.forest_classifier().getNumTrees()) == 29


def test_forests_read_like_rows_next_to_each_other(spark, monkeypatch):
    rows = [(None if i % 50 == 0 else i % 180, None if i % 7 == 0 else "cab"[i % 3], float(i % 5), float(i)) for i in range(400)]
    train = spark.createDataFrame(rows, "k int, c string, x double, label double")
    seen = []

    def in_order(est, cols):
        with_place = ML.dealt(train, "k", est, cols).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
        got = with_place.orderBy("i").collect()
        assert sorted(r["label"] for r in got) == [float(i) for i in range(400)]
        parts = {p: [r for r in got if r["p"] == p] for p in {r["p"] for r in got}}
        seen.append({r["label"]: r["p"] for r in got})
        return lambda *by: all(v == sorted(v) for v in ([tuple((r[c] is not None, r[c] or 0) if c != "c" else (r[c] is not None, r[c] or "") for c in by)
                                                        for r in part] for part in parts.values()))

    forest = in_order(ML.forest_regressor(trees=3), ["c", "x"])
    assert forest("c", "x", "k") and not forest("k")
    other = in_order(ML.linear_regression(), ["c", "x"])
    assert other("k") and not other("c", "x")
    assert seen[0] == seen[1]  # rows are dealt by the key in both

    asked = []
    real = ML.dealt
    monkeypatch.setattr(ML, "dealt", lambda t, key, est, cols: asked.append(list(cols)) or real(t, key, est, cols))
    ML.fit_model(train, ["c", "x"], ML.forest_regressor(trees=2, depth=2), key="k")
    Q._gender_forest(spark, SF_SMALL)
    assert asked == [["c", "x"], ["age", "company_enc", "name_length", "first_letter_enc", "last_letter_enc"]]


def test_boosted_trees_read_their_training_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = spark.range(600, numPartitions=2).select(F.col("id").alias("k"), watched((F.col("id") % 7).cast("double")).alias("label"))
    rows = ML.VectorAssembler(inputCols=["k"], outputCol=ML.FEATURES_COL).transform(rows)
    model = ML.fit_dealt(rows, "k", ML.gbt_regressor().setMaxIter(3))
    assert seen.value == 600 and model.getNumTrees == 3
