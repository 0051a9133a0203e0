"""Property tests of scalar columns against plain-Python references."""

import re

from hypothesis import given, settings, strategies as st

from tripcast.functions import columns as C

CITY = re.compile(r"^(.*?)\s*\(")
STATE = re.compile(r"\(([A-Z]{2})\)")

places = st.one_of(
    st.builds(lambda c, s: f"{c} ({s})", st.text("abc XYZ", min_size=0, max_size=8),
              st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=1, max_size=3)),
    st.text("ab ()XYZ", max_size=10),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(places, min_size=1, max_size=20))
def test_place_parts(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "p string")
    got = [tuple(r) for r in df.select(C.city_of("p"), C.state_of("p")).collect()]
    exp = []
    for x in xs:
        m = CITY.search(x)
        s = STATE.search(x)
        exp.append((m.group(1) if m else x, s.group(1) if s else None))
    assert got == exp


def _band(a):
    for lo, hi, label in C.AGE_BANDS:
        if a is not None and lo <= a < hi:
            return label
    return None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 130)), min_size=1, max_size=30))
def test_age_band(spark, ages):
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    assert [r[0] for r in df.select(C.age_band("age")).collect()] == [_band(a) for a in ages]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("Ab x", max_size=8)), min_size=1, max_size=20))
def test_name_codes(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in df.select(*C.name_codes("name").values()).collect()]
    exp = []
    for n in names:
        n = n or ""
        if not n or not n.split():
            exp.append((0, 0, 0) if not n else None)
            continue
        tok = n.split()[0]
        exp.append((len(tok), ord(n[0].upper()) - 65, ord(tok[-1].lower()) - 97))
    assert [g for g, e in zip(got, exp) if e is not None] == [e for e in exp if e is not None]
