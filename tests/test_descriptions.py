"""Readers of descriptions and safety of links, by cases."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from lotwise.functions import descriptions as D
from lotwise.operators import link_safety as L
from lotwise.sources.scratch import stored


def each(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_overlap(spark):
    pairs = spark.createDataFrame([("Plot 12 a at Salem", "salem plot 12, X"), ("a b", "plot"), (None, "plot"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(D.overlap(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 0.0, 0.0]


def test_areas(spark):
    got = each(spark, D.areas, ["1,295 sq ft and 20.50 cents", "0.5 acre; 1 sq.yd", "0 cents", "house", None])
    assert got == [[1295.0, 8929.8], [9.0, 21780.0], [], [], []]


def test_places(spark):
    assert each(spark, D.place_name, ["Kundrathur.", "Sriperumbudur  Taluk", "X Village Taluk", "A & B", "Taluk", None]) == ["kundrathur", "sriperumbudur", "x", "a and b", None, None]
    assert each(spark, D.says_taluk, ["Salem TK.", "Talukdar Nagar", None]) == [True, False, False]


@pytest.mark.parametrize(
    ("quote", "unit", "want"),
    [
        ("Rs.70.00 Lakhs", None, (7_000_000, "ok")), ("28.89", "lakh", (2_889_000, "ok")), ("Rs. 2889000/- (Rupees Twenty Eight Lakhs)", "lakh", (2_889_000, "ok")), ("1.25 crores", "lakh", (12_500_000, "ok")),
        ("35.15,000", None, (3_515_000, "ok")), ("3.51,500", None, (351_500, "ok")), ("1O0", None, (None, "illegible")), ("12.50.000", None, (None, "illegible")), ("0", None, (None, "illegible")), ("as agreed", None, (None, "none")), (" ", None, (None, "none")), (None, None, (None, "none")),
    ],
)
def test_money(spark, quote, unit, want):
    assert tuple(spark.createDataFrame([(quote, unit)], "q string, u string").select(*D.read_money(F.col("q"), F.col("u"))).first()) == want


def test_possession_and_glued_fields(spark):
    assert each(spark, D.possession, ["Symbolic possession", "symbolic/physical", "none stated", None]) == ["symbolic", None, None, None]
    assert each(spark, D.without_glued_fields, ["Land at Salem, Province/State TN", "Registration District of X", "City/Town", None]) == ["Land at Salem", "Registration District of X", "", None]


def test_link_safety(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, "x"), (2, "b", 5.0, None), (3, "a", 6.0, "x"), (4, "c", 5.0, "y"), (5, "c", 5.2, "z"), (6, "d", 1.0, None)], "id long, source string, price double, unit string")
    pairs = [(1, 2, "CONFIRMED"), (2, 3, "CONFIRMED"), (4, 6, "CONFIRMED"), (5, 6, "CONFIRMED"), (1, 3, "PENDING"), (1, 2, "PENDING"), (1, 6, "PENDING")]
    links = spark.createDataFrame(pairs, "a long, b long, confidence string")
    got = {tuple(r) for r in L.problems(links, rows, partial(stored, name="test")).collect()}
    assert got == {("prices_differ", 1, 3), ("units_differ", 4, 5), ("already_merged", 1, 3), ("confirmed_and_pending", 1, 2)}
    assert L.problems(links.where("a = 4"), rows, partial(stored, name="test")).count() == 0


def test_spot_sample_is_the_same_for_a_day(spark):
    pairs = spark.createDataFrame([(i, "s", "CONFIRMED") for i in range(50)], "a long, source string, confidence string")
    none = spark.createDataFrame([(3, "s")], "a long, source string")
    draw = lambda day: [tuple(r) for r in L.spot_sample(pairs, none, day, 5).collect()]
    assert draw("2024-01-01") == draw("2024-01-01") != draw("2024-01-02") and (3, "s") not in draw("2024-01-01")
