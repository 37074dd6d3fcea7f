import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citegraph.functions import geo, text
from citegraph.operators.normalise import date_intervals_of
from conftest import as_set


def test_abstract_is_laid_out_by_position(make):
    df = make(
        "id int, m map<string, array<int>>",
        (1, {"b": [1, 3], "a": [0], "c": [2]}),
        (2, None),
        (3, {}),
        (4, {"x\x00y": [0], "z": [5]}),
    )
    result = dict(as_set(df.select("id", text.abstract_from_inverted_index(F.col("m")))))
    assert result == {1: "a b c b", 2: None, 3: "", 4: "xy z"}


def test_abstract_position_clash_goes_to_the_later_entry(spark):
    df = spark.sql("select map('first', array(0, 1), 'second', array(1)) as m")
    assert df.select(text.abstract_from_inverted_index(F.col("m"))).first()[0] == "first second"


def test_abstract_round_trip(make):
    rng = random.Random(1)
    words = [rng.choice(["alpha", "beta", "", "é", "gamma,"]) for _ in range(500)]
    index = {}
    for i, word in enumerate(words):
        index.setdefault(word, []).append(i)
    df = make("m map<string, array<int>>", (index,))
    assert df.select(text.abstract_from_inverted_index(F.col("m"))).first()[0] == " ".join(words)


@pytest.mark.parametrize(
    "name, expected",
    [
        ("A. B. FooBar", None),
        ("A. FooBar", None),
        ("Foo A. FooBar", "Foo FooBar"),
        ("Foo FooBar", "Foo FooBar"),
        ("허준 ( Joon Hur ) 이용구 ( Yong Goo Lee )", "허준 Joon Hur 이용구 Yong Goo Lee"),
        ("Foo", None),
        ("", None),
        ("Jean-P Dupont", "Jean Dupont"),
        ('"Ann" (Bee) Cee!', "Ann Bee Cee"),
        ("Mary--Ann Lee", "MaryAnn Lee"),
        ("É-Z Foo Bar", "Foo Bar"),  # what is left of "É-Z" is a single letter
        ("Foo  X Bar", "Foo Bar"),
        ("Ann .B Lee", "AnnB Lee"),
        ("Ann .Lee", "Ann .Lee"),
        ("Ann J.-P. Lee", "Ann Lee"),
        ("Ann Lee ", "Ann Lee"),
    ],
)
def test_clean_name(make, name, expected):
    got = make("name string", (name,)).select(text.clean_name(F.col("name"))).first()[0]
    assert got == expected


def test_flags(make):
    df = make("name string", ("university of x",), ("University of X",), ("co. ltd",), (None,))
    assert [r[0] for r in df.select(text.contains_any(F.col("name"), ("university", "a.b"))).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in df.select(text.contains_any(F.col("name"), ("co. l",))).collect()] == [0, 0, 1, 0]
    assert [r[0] for r in df.select(text.equals_any(F.col("name"), ("co. ltd",))).collect()] == [0, 0, 1, 0]


def test_dot_in_a_token_is_literal(make):
    df = make("name string", ("st gallen",), ("stxgallen",), ("st.gallen",))
    assert [r[0] for r in df.select(text.contains_any(F.col("name"), ("st.gallen",))).collect()] == [0, 0, 1]


def test_tokens(make):
    df = make("t string", ("The naïve_x, a b2 ½½ — 東京!",))
    assert df.select(text.tokens(F.col("t"))).first()[0] == ["the", "naïve_x", "b2", "½½", "東京"]


def test_address_component_precedence(make):
    schema = "c array<struct<long_name: string, types: array<string>>>"
    df = make(schema, ([("old", ["country"]), ("town", ["country", "postal_town"]), ("new", ["country"])],), ([],))
    rows = df.select(*[geo.address_component(F.col("c"), kind) for kind in geo.COMPONENT_TYPES]).collect()
    assert [tuple(r) for r in rows] == [("town", None, None, "new"), (None, None, None, None)]


def python_boundaries(start, end, count):
    step = (end - start) / count
    return [(start + step * i).strftime("%Y-%m-%d") for i in range(count)] + [end.strftime("%Y-%m-%d")]


def test_golden_boundaries():
    start, end = datetime(2000, 1, 1), datetime(2000, 12, 31)
    assert python_boundaries(start, end, 6) == [
        "2000-01-01", "2000-03-01", "2000-05-01", "2000-07-01", "2000-08-31", "2000-10-31", "2000-12-31",
    ]


@pytest.mark.parametrize(
    "start, end, count",
    [
        (datetime(2000, 1, 1), datetime(2000, 12, 31), 6),
        (datetime(1999, 5, 3), datetime(2003, 2, 1, 13, 45, 7, 123456), 7),
        (datetime(2000, 1, 1), datetime(2000, 1, 9), 20),
    ],
)
def test_intervals_equal_a_brute_force_range_join(make, start, end, count):
    days = [(start + timedelta(days=d)).strftime("%Y-%m-%d") for d in range(-3, (end - start).days + 4)]
    bounds = python_boundaries(start, end, count)
    expected = {
        (day, a, b) for day in days for a, b in zip(bounds, bounds[1:]) if a <= day <= b
    }
    got = date_intervals_of(make("date string", *[(d,) for d in days]), start, end, count)
    assert as_set(got.select("date", "interval_start", "interval_end")) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Pacific/Auckland"])
def test_intervals_do_not_depend_on_the_session_zone(spark, make, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = make("date string", ("1999-12-31",), ("2000-01-01",), ("2002-12-31",), ("2003-01-01",))
        got = date_intervals_of(days, datetime(2000, 1, 1), datetime(2002, 12, 31), 3)
        assert as_set(got) == {
            ("2000-01-01", "2000-01-01", "2000-12-31"), ("2002-12-31", "2001-12-31", "2002-12-31"),
        }
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
