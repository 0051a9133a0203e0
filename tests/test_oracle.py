"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tripcast.sources.tables import DRIVER_TABLES
from conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (5, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan") if isinstance(v, float) and math.isnan(v) else (2, repr(float(v)))
    if hasattr(v, "isoformat"):
        return (4, str(v)[:19])
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    return (5, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["month", "flightType", "avg_price_inr"]
