"""Command line: the source application's scripts as Spark jobs.

    python -m tripcast train-regression  --sf-dir D --out DIR [--trees 50]
    python -m tripcast train-classifier  --sf-dir D --out DIR [--trees 500]
    python -m tripcast evaluate          --sf-dir D --model DIR --task regression|classification [--full]
    python -m tripcast recommend         --sf-dir D --out DIR [--requests JSON_DIR] [--top-n 5]
    python -m tripcast score-prices      --model DIR --requests JSON_DIR --out DIR [--stream --checkpoint DIR]
    python -m tripcast query             --sf-dir D --name AGG2_monthly_price_by_class [--out DIR]
    python -m tripcast materialize       --sf-dir D --out DIR      (year-partitioned travel tables)

Every command runs on the active cluster session (or a local one when started
stand-alone) and writes its result as parquet; nothing is collected except
metrics and the run log's one-row summaries.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import evaluation as EV
from .operators import ml as ML
from .operators import recommend as R
from .plans import catalog as Q
from .session import build_session, ensure_checkpoint_dir
from .sources import fixtures as FX
from .sources import schemas
from .sources import warehouse as W
from .streaming import scoring as SC


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    return build_session("tripcast-cli")


def train_regression(spark, sf_dir: str, out: str, trees: int = 50) -> dict:
    """Baseline linear regression vs random forest; keep the forest only when strictly better."""
    tr, te = Q._flight_frames(spark, sf_dir)
    runs = f"{out}/runs"
    models = {}
    for name, est in [("LinearRegression", ML.linear_regression()), ("RandomForest", ML.forest_regressor(trees=trees))]:
        model, m = ML.train_regressor(tr, te, est, Q.FLIGHT_COLS, ML.FLIGHT_ORDER)
        ML.log_run(spark, runs, "flight_price", name, ML.model_params(model), m)
        models[name] = model
    best = ML.best_run(spark.read.parquet(runs).where(F.col("experiment") == "flight_price"),
                       "r2", "LinearRegression").first()
    ML.save_model(models[best["selected_model"]], f"{out}/model")
    return {"selected": best["selected_model"], "r2": best["selected_metric"]}


def train_classifier(spark, sf_dir: str, out: str, trees: int = 500) -> dict:
    """Balanced logistic regression vs balanced random forest on the users table (weighted F1)."""
    tr, te = Q._user_frames(spark, sf_dir)
    runs = f"{out}/runs"
    models = {}
    n = tr.count()
    for name, est in [("LogisticRegression", ML.logistic_regression(n)), ("RandomForest", ML.forest_classifier(trees=trees))]:
        model, m = ML.train_classifier(tr, te, est, ML.USER_FEATURES)
        ML.log_run(spark, runs, "traveller_gender", name, ML.model_params(model), m)
        models[name] = model
    best = ML.best_run(spark.read.parquet(runs).where(F.col("experiment") == "traveller_gender"),
                       "f1", "LogisticRegression").first()
    ML.save_model(models[best["selected_model"]], f"{out}/model")
    return {"selected": best["selected_model"], "f1": best["selected_metric"]}


def evaluate(spark, sf_dir: str, model_dir: str, task: str, full: bool = False) -> dict:
    """EVA3: held-out split by default, the full table with ``full``."""
    model = ML.load_model(model_dir)
    if task == "regression":
        tr, te = Q._flight_frames(spark, sf_dir)
        data = tr.unionByName(te) if full else te
        return EV.regression_metrics(model.transform(data)).first().asDict()
    tr, te = Q._user_frames(spark, sf_dir)
    data = tr.unionByName(te) if full else te
    labels = model.stages[0].labels
    preds = ML.IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels) \
        .transform(model.transform(data.withColumn("class_weight", F.lit(1.0))))
    return EV.classification_metrics(preds, "label", "predicted_label").first().asDict()


def recommend(spark, sf_dir: str, out: str, requests: str | None = None, top_n: int = 5) -> int:
    model = R.fit(Q._catalogue(spark, sf_dir))
    if requests:
        schema = T.StructType([T.StructField("request_id", T.LongType())] + list(schemas.HOTEL_REQUEST.fields))
        reqs = spark.read.schema(schema).json(requests)
    else:
        reqs = FX.hotel_requests(Q._f(spark, sf_dir))
    recs = R.recommend(model, reqs, top_n=top_n)
    recs.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def score_prices(spark, model_dir: str, requests: str, out: str, stream: bool = False,
                 checkpoint: str | None = None) -> None:
    model = ML.load_model(model_dir)
    schema = "request_id long, body string"

    def transform(df):
        valid, _ = SC.split_valid(SC.route_requests(SC.once(df)))
        return SC.score_prices(model, valid.select("request_id", "req.*"))

    if stream:
        SC.run_stream(spark, transform, spark.read.schema(schema).json(requests).schema, requests, out,
                      checkpoint or f"{out}_checkpoint")
    else:
        transform(spark.read.schema(schema).json(requests)).write.mode("overwrite").parquet(out)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tripcast")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ["train-regression", "train-classifier"]:
        s = sub.add_parser(name)
        s.add_argument("--sf-dir", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--trees", type=int)
    s = sub.add_parser("evaluate")
    s.add_argument("--sf-dir", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--task", choices=["regression", "classification"], required=True)
    s.add_argument("--full", action="store_true")
    s = sub.add_parser("recommend")
    s.add_argument("--sf-dir", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--requests")
    s.add_argument("--top-n", type=int, default=5)
    s = sub.add_parser("score-prices")
    s.add_argument("--model", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--stream", action="store_true")
    s.add_argument("--checkpoint")
    s = sub.add_parser("materialize")
    s.add_argument("--sf-dir", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("query")
    s.add_argument("--sf-dir", required=True)
    s.add_argument("--name", required=True)
    s.add_argument("--out")
    a = p.parse_args(argv)
    spark = _session()
    if a.cmd == "train-regression":
        print(json.dumps(train_regression(spark, a.sf_dir, a.out, a.trees or 50)))
    elif a.cmd == "train-classifier":
        print(json.dumps(train_classifier(spark, a.sf_dir, a.out, a.trees or 500)))
    elif a.cmd == "evaluate":
        print(json.dumps(evaluate(spark, a.sf_dir, a.model, a.task, a.full)))
    elif a.cmd == "recommend":
        print(json.dumps({"rows": recommend(spark, a.sf_dir, a.out, a.requests, a.top_n)}))
    elif a.cmd == "score-prices":
        score_prices(spark, a.model, a.requests, a.out, a.stream, a.checkpoint)
    elif a.cmd == "materialize":
        print(json.dumps(W.materialize(spark, a.sf_dir, a.out)))
    elif a.cmd == "query":
        df = Q.QUERIES[a.name](spark, a.sf_dir)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(50, truncate=False)


if __name__ == "__main__":
    main()
