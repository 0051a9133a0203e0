"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver); the time of a query is the
best of ``BENCH_REPEAT`` (default 2) runs, which damps VM noise. Prints one
JSON line. ``BENCH_EVENT_LOG=<dir>`` writes Spark's event log there (stage and
task metrics, shuffle bytes) for offline inspection.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripcast.plans.catalog import QUERIES  # noqa: E402
from tripcast.session import build_session  # noqa: E402

HEADLINE = [
    "AGG1_kpi_row",
    "AGG2_monthly_price_by_class",
    "AGG11_TOP1_top_routes",
    "AGG16_spend_by_gender",
    "JOIN1_flights_users",
    "SET1_unique_cities",
    "SMP4_stratified_split",
    "FEA8_documents_tfidf",
    "REC10_recommend",
    "EVA1_regression_metrics",
    "MDL1_linear_regression",
    "MDL5_gbt_regressor",
    "SCR1_price_scoring",
    "SCR4_FLT6_SRC7_request_routing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session("tripcast-bench", cpus, event_log_dir=os.environ.get("BENCH_EVENT_LOG"))
    # warm-up, not timed: JVM class loading and JIT of the shared view plans
    # (nothing is cached; every timed query recomputes from the parquet files)
    for warm in ["AGG14_company_users", "SRC3_flights_typed", "SRC4_hotels_typed"]:
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            el = time.perf_counter() - t0
            best = el if best is None else min(best, el)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "timing": f"best of {repeat} runs per query, noop sink",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
