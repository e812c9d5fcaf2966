import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lotwise.functions import measures as M
from lotwise.operators import resolution as R

from .test_functions import one


@pytest.mark.parametrize(("text", "want"), [("12 ft 6 in", 12.5), ("10 metres", 32.81), ("40", 40.0), ("1200 sq ft", None), ("wide", None), (None, None)])
def test_length(spark, text, want):
    assert one(spark, M.length_feet, text) == want


def test_neighbours_and_amounts(spark):
    assert one(spark, M.adjacency, "setback of 30 feet road") == "setback" and one(spark, M.adjacency, "30 ft road") == "road" and one(spark, M.adjacency, None) is None
    assert one(spark, M.road_width, "30 ft road") == 30.0 and one(spark, M.road_width, "plot of 30 ft") is None
    assert one(spark, M.amounts_in, "Reserve 12,34,567 or 2.5 crore, emd 1.2 Lakhs") == [1234567, 25_000_000, 120_000]
    assert one(spark, M.strict_ids, "S.No. 72/1B of 12/03/2020 and 72/1B1") == ["72/1b", "72/1b1"]
    assert one(spark, M.loose_ids, "door 45, year 2019, 7") == ["45"]
    assert one(spark, M.portal_ids, "see BN-359826, 841207 and 12345") == ["bn-359826", "841207"]


def test_parcel_gate(spark):
    rows = [("72/1b x", "72/1b y", 0.0, False), ("72/1b", "72/2", 1.0, True), ("door 45", "door 45", 0.0, False), ("a", "b", 0.7, True), ("a", "b", 0.7, None), ("a", "b", 0.5, True)]
    df = spark.createDataFrame(rows, "a string, b string, s double, area boolean")
    assert [r[0] for r in df.select(M.same_parcel("a", "b", F.col("s"), F.col("area"))).collect()] == [True, False, True, True, False, False]


def test_headline(spark):
    df = spark.createDataFrame([({"uds_parent": 9.0, "carpet": 5.0}, "flat"), ({"uds_parent": 9.0}, "plot"), ({"extent": 3.0, "total": 4.0}, "plot")], "m map<string,double>, b string")
    assert [r[0] for r in df.select(M.headline(F.col("m"), F.col("b"))).collect()] == [5.0, None, 4.0]


def test_variants_and_proposals(spark):
    names = spark.createDataFrame([("Canara Bank",), ("Canara Bonk",), ("Union Bank of India",), ("State Bank of India",), ("Bank of India",)], "name string")
    assert {tuple(r) for r in R.ocr_variants(names, "name").collect()} == {("Canara Bank", "Canara Bonk")}
    got = R.merge_proposals(names, "name", F.lit("all")).collect()
    assert {(r["a"], r["b"]) for r in got} >= {("Canara Bank", "Canara Bonk")} and all(r["score"] >= 88 for r in got)


def test_hints_cancel(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    a, b = spark.createDataFrame([(1, "x"), (2, "x")], "id int, place string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, place string")
    assert {tuple(r) for r in R.hinted(rows, "id", [a, b], "place").collect()} == {(1, "x", 2), (2, None, 0), (3, None, 0)}


def test_bundles_and_parts(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "hello")
    df = spark.createDataFrame([("p", out.getvalue()), ("q", b"no zip"), ("r", None)], "path string, content binary")
    assert [(r["path"], r["member"], r["size"]) for r in R.expanded_bundles(df).collect()] == [("p", "a/b.txt", 5)]
    texts = spark.createDataFrame([(1, "lead\n1. first lot\n2) second\n7. stray\n3. third"), (2, "1. only"), (3, None)], "id int, t string")
    assert [(r["number"], r["part"]) for r in R.numbered_parts(texts, "id", "t").orderBy("number").collect()] == [(1, "first lot"), (2, "second"), (3, "third")]


def test_confidence_of_unknown_methods(spark):
    assert one(spark, R.confidence, "four_field") == "CONFIRMED" and one(spark, R.confidence, "x") == "UNKNOWN"
