"""The command-line jobs end to end on the smallest tables."""

import json

from tripcast import __main__ as cli
from tripcast.plans import catalog as Q
from tripcast.streaming import scoring as SC
from conftest import SF_SMALL


def test_train_evaluate_score(spark, tmp_path):
    out = str(tmp_path / "reg")
    res = cli.train_regression(spark, SF_SMALL, out, trees=10)
    assert res["selected"] in ("LinearRegression", "RandomForest") and res["r2"] > 0.9
    held = cli.evaluate(spark, SF_SMALL, f"{out}/model", "regression")
    full = cli.evaluate(spark, SF_SMALL, f"{out}/model", "regression", full=True)
    assert held["r2"] > 0.9 and full["r2"] > 0.9
    bodies = str(tmp_path / "bodies")
    Q._request_bodies(spark, SF_SMALL).select("request_id", "body").write.json(bodies)
    cli.score_prices(spark, f"{out}/model", bodies, str(tmp_path / "scored"))
    batch = spark.read.parquet(str(tmp_path / "scored"))
    cli.score_prices(spark, f"{out}/model", bodies, str(tmp_path / "streamed"), stream=True,
                     checkpoint=str(tmp_path / "ck"))
    streamed = spark.read.parquet(str(tmp_path / "streamed"))
    assert batch.count() == streamed.count() > 0


def test_classifier_and_recommend(spark, tmp_path):
    res = cli.train_classifier(spark, SF_SMALL, str(tmp_path / "cls"), trees=10)
    assert res["f1"] > 0.5
    m = cli.evaluate(spark, SF_SMALL, str(tmp_path / "cls" / "model"), "classification")
    assert 0.0 <= m["accuracy"] <= 1.0
    rows = cli.recommend(spark, SF_SMALL, str(tmp_path / "recs"))
    assert rows > 0
    reqs = tmp_path / "reqs.json"
    reqs.write_text(json.dumps({"request_id": 1, "destination": "NATION 1", "amenities": ["wifi"],
                                "budget_max": 300.0, "min_stars": 3, "min_review": 7.0}) + "\n")
    assert cli.recommend(spark, SF_SMALL, str(tmp_path / "recs2"), str(reqs)) >= 1


def test_main_query_and_materialize(spark, tmp_path):
    cli.main(["query", "--sf-dir", SF_SMALL, "--name", "AGG14_company_users", "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 5
    cli.main(["materialize", "--sf-dir", SF_SMALL, "--out", str(tmp_path / "wh")])
    assert spark.read.parquet(str(tmp_path / "wh" / "flights")).count() == 1500
