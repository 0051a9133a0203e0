"""Summary cube: tabs equal the plain queries, parts merge, one year is refreshed alone."""

import os

import pytest
from pyspark.sql import functions as F

from tripcast.operators import cube as CU
from tripcast.operators import dashboard as D
from tripcast.plans.catalog import CLASSES, YEARS, _f, _h
from conftest import SF_SMALL


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def views(spark):
    return _f(spark, SF_SMALL).persist(), _h(spark, SF_SMALL).persist()


def test_tabs_equal_the_plain_queries(spark, tmp_path, views):
    f, h = views
    CU.refresh(CU.flight_cube(f), str(tmp_path / "f"))
    CU.refresh(CU.hotel_cube(h), str(tmp_path / "h"))
    cf, ch = CU.load(spark, str(tmp_path / "f")), CU.load(spark, str(tmp_path / "h"))
    assert cf.agg(F.sum("bookings")).first()[0] == f.count()
    for name, a, b in [
        ("kpi", CU.kpi_row(cf, ch, YEARS), D.kpi_row(f, h, YEARS)),
        ("kpi of all years", CU.kpi_row(cf, ch), D.kpi_row(f, h)),
        ("months", CU.monthly_price_by_class(cf, YEARS, CLASSES), D.monthly_price_by_class(f, YEARS, CLASSES)),
        ("bookings", CU.monthly_bookings(cf), D.monthly_bookings(f)),
        ("agencies", CU.agency_share(cf, YEARS), D.agency_share(f, YEARS)),
        ("classes", CU.class_mean_price(cf), D.class_mean_price(f)),
        ("hotel months", CU.hotel_monthly_price(ch, YEARS), D.hotel_monthly_price(h, YEARS)),
        ("hotels", CU.hotel_bookings(ch), D.hotel_bookings(h)),
        ("cities", CU.city_mean_price(ch), D.city_mean_price(h)),
        ("stays", CU.stay_lengths(ch), D.stay_lengths(h)),
        ("destinations", CU.destinations(cf), D.destinations(f)),
        ("routes", CU.top_routes(cf), D.top_routes(f)),
    ]:
        assert _rows(a) == _rows(b), name


def test_parts_merge_into_the_whole(views):
    f, _ = views
    part = F.pmod(F.xxhash64("travelCode"), F.lit(3))
    merged = CU.merge(*[CU.flight_cube(f.where(part == i)) for i in range(3)])
    whole = CU.flight_cube(f)
    assert merged.dtypes == whole.dtypes and _rows(merged) == _rows(whole)


def test_one_year_is_refreshed_alone(spark, tmp_path, views):
    f, _ = views
    path = str(tmp_path / "f")
    year = F.year("date")
    stale = f.where((year != 1996) | year.isNull() | (F.col("flightType") == "economic"))
    CU.refresh(CU.flight_cube(stale), path)

    def others():
        return {(r, n, os.stat(os.path.join(r, n)).st_mtime_ns) for r, _, names in os.walk(path) for n in names if "year=" in r and "year=1996" not in r}

    before = others()
    CU.refresh(CU.flight_cube(f), path, [1996])
    assert others() == before and before
    assert _rows(CU.load(spark, path)) == _rows(CU.flight_cube(f))
    # a year that lost its bookings becomes empty, and so does the null year
    CU.refresh(CU.flight_cube(f.where((year != 1996) & (year != 1998))), path, [1996, None])
    left = CU.load(spark, path)
    assert _rows(left) == _rows(CU.flight_cube(f.where(year != 1996)))
    plan = CU.load(spark, path, [1997])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan


def test_empty_null_and_odd_rows(spark, tmp_path, views):
    f, h = views
    empty = str(tmp_path / "e")
    CU.refresh(CU.flight_cube(f.limit(0)), empty)
    none = CU.load(spark, empty)
    assert none.count() == 0 and CU.top_routes(none).count() == 0
    assert _rows(CU.kpi_row(none, CU.hotel_cube(h.limit(0)))) == [(None, None, None, None, None, None, 0)]
    odd = spark.sql("""SELECT CAST(c1 AS DATE) AS date, c2 AS flightType, CAST(NULL AS STRING) AS agency, c2 AS from_city, c3 AS to_city, CAST(c4 AS DOUBLE) AS price_inr, 1 AS year, 'x' AS bookings
                       FROM VALUES ('1996-01-05', 'a', 'p', '1.5'), (NULL, NULL, NULL, NULL), ('1996-01-06', 'a', 'p', 'NaN'), ('1996-01-06', 'a', 'p', 'Infinity'), ('1996-01-05', 'a', 'p', '1.5') AS t(c1, c2, c3, c4)""")
    got = {r["year"]: r.asDict() for r in CU.flight_cube(odd).collect()}
    assert got[1996]["bookings"] == 4 and got[1996]["price_inr__n"] == 2 and float(got[1996]["price_inr__sum"]) == 3.0
    assert got[None]["bookings"] == 1 and got[None]["price_inr__n"] == 0 and got[None]["price_inr__sum"] == 0
