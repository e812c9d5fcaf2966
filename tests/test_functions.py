import pytest
from pyspark.sql import functions as F

from lotwise.functions import areas as Ar
from lotwise.functions import normalize as N
from lotwise.functions import similarity as S
from lotwise.operators import analytics as A
from lotwise.operators import linkage as L
from lotwise.operators import search as Se
from lotwise.operators import text as T
from lotwise.sources import tables as Ta
from lotwise.sources.scratch import stored


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"x{i}") for i in range(len(values))]).alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("1295 Sq Ft", 1295.0), ("0.5 acre", 21780.0), ("3 cents", 1306.8), ("1295", 1295.0), ("5", None), ("0.49.5 Hectares", 53281.36), (None, None), ("", None), ("120 sq m", 1291.67)])
def test_area(spark, text, want):
    got = one(spark, Ar.total_sqft, text)
    assert got == want or abs(got - want) < 0.02


@pytest.mark.parametrize(("text", "want"), [("₹ 12,34,567.50", 1234567.5), ("Rs. 500/-", None), ("1 23", None), ("-5", -5.0), ("â‚¹1,23,456.00", 123456.0), ("no price", None), (None, None), ("", None)])
def test_price(spark, text, want):
    assert one(spark, N.clean_price, text) == want


@pytest.mark.parametrize(("text", "want"), [("Rs 2.5 Crore", 25_000_000.0), ("45 lakhs", 4_500_000.0), ("1,200", 1200.0), ("none", None)])
def test_money(spark, text, want):
    assert one(spark, N.parse_money, text) == want


def test_names_and_identifiers(spark):
    assert one(spark, N.area_name, "Vedasandur.") == "vedasandur" and one(spark, N.area_name, "Poonamallee Taluk") == "poonamallee"
    key = lambda t: one(spark, N.org_key, t)
    assert key("Canara Bank") == key("CANARA BANK") and key("Repco Home Finance Limited") == key("Repco Home Finance Ltd.")
    assert key("Bank of India") != key("State Bank of India") and key("Union Bank of India") != key("City Union Bank Ltd")
    assert one(spark, N.identifier_value, "72/1B") != one(spark, N.identifier_value, "72/1B1")
    assert one(spark, N.identifier_value, " 072/ 1b") == one(spark, N.identifier_value, "72/1B")
    assert one(spark, N.borrower_key, "Mr. A  Kumar") == "a kumar"
    assert one(spark, N.borrower_key, "M/s. A.B. Mills (P) Ltd") == "a b mills p ltd"
    assert {one(spark, N.branch_key, t) for t in ("ARM Branch Trichy", "Trichy ARM Branch", "ARM TRICHY")} == {"arm trichy"}
    assert one(spark, N.branch_key, "ARM I") != one(spark, N.branch_key, "ARM II")
    assert [one(spark, N.family_value, t) for t in ("381 BY 5A", "381-5a", "300/3")] == ["381/5a", "381/5a", "300/3"]
    assert one(spark, N.property_bucket, "Residential flat with shop") == "flat" and one(spark, N.property_bucket, None) == "unknown"
    assert one(spark, N.slug, " Two  BHK / flat!") == "two-bhk-flat"


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 100.0), ("", "", 100.0), ("abc", "", 0.0), ("kitten", "sitting", 100 * 2 * 4 / 13)])
def test_ratio(a, b, want):
    assert S.indel_ratio(a, b) == pytest.approx(want) == S.indel_ratio(b, a)


def test_fuzzy_scores(spark):
    assert S.token_set("state bank of india", "india bank state of") == 100
    assert S.token_set("a b", "a b c d") == 100 and S.token_set("", "a") == 0
    assert S.partial("plot 7", "the plot 7 at x") == 100
    assert (S.edits("ca", "abc"), S.edits("abcd", "acbd"), S.edits("", "abc")) == (3, 1, 3)
    assert one(spark, S.token_sort_ratio, "b a", "a b") == 100.0
    assert one(spark, S.ratio, None, "a") is None
    assert one(spark, S.damerau_levenshtein, "abcd", "acbd") == 1


def test_agreement_and_wilson(spark):
    df = spark.createDataFrame([(100.0, 100.9), (100.0, 1000.0), (100.0, 150.0), (0.0, 5.0), (None, 5.0), (105.0, 10_000.0)], "a double, b double")
    assert [r[0] for r in df.select(A.agreement("a", "b")).collect()] == ["agree", "magnitude_slip", "disagree", "unknown", "unknown", "magnitude_slip"]
    low, high = A.wilson(F.lit(20), F.lit(20))
    assert spark.range(1).select(F.round(low, 2), high).first()[0] == 0.84
    low, high = A.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)


def test_filters_drop_only_what_may_go():
    f = Se.Filters().keep("area", F.lit(True)).add("a", F.lit(True)).add("b", None)
    assert f.droppable == ["a"] and list(f.without("area", "a").conditions) == ["area"]
    with pytest.raises(ValueError):
        Se.between("x", 5, 4)
    assert Se.page_size(0) == 50 and Se.page_size(500) == 50 and Se.page_size(7) == 7


def test_relax_needs_two_filters(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    both = Se.Filters().add("x", F.col("x") == 1).add("y", F.col("y") == 4)
    assert {(r["dropped"], r["n"]) for r in Se.relax(df, both).collect()} == {("x", 1), ("y", 1)}
    assert Se.relax(df, Se.Filters().add("x", F.col("x") == 9)).count() == 0


def test_null_dates_and_ranks(spark):
    df = spark.createDataFrame([(1, "c", None, 5.0), (2, "c", "2020-01-02", None), (3, "c", "2020-01-01", 7.0)], "id int, chain string, d string, price double").withColumn("d", F.to_timestamp("d"))
    chain = {r["id"]: (r["attempt_no"], r["previous_id"]) for r in A.attempt_chain(df, "chain", "d", "id", "price").collect()}
    assert chain == {3: (1, None), 2: (2, 3), 1: (3, 2)}
    best = A.first_present(df, "chain", "id", "id", ["price", "d"]).first()
    assert (best["price"], best["price_from"], best["d_from"]) == (5.0, 1, 2)


def test_deadline_alerts(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00",), ("2024-01-03 21:36:00",), ("2024-01-07 00:00:00",), ("2023-12-31 00:00:00",), ("2024-01-09 00:00:01",), (None,)], "d string").withColumn("d", F.to_timestamp("d"))
    severity, days = A.deadline_alert("d", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [tuple(r) for r in df.select(severity, F.when(severity.isNotNull(), days)).collect()] == [("urgent", 0), ("soon", 2), ("upcoming", 6), (None, None), (None, None), (None, None)]


def test_clusters_of_bridged_listings(spark):
    members = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    links = spark.createDataFrame([(1, 2, "PROBABLE"), (2, 3, "CONFIRMED")], "a long, b long, confidence string")
    found = L.components(links, stored)
    every = members.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    assert {tuple(r) for r in L.cluster_grades(every, links).collect()} == {(1, 3, "PROBABLE"), (4, 1, "SINGLE"), (5, 1, "SINGLE")}


def test_event_id(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],), (["x"],)], "ids array<string>")
    a, b, c = (r[0] for r in df.select(A.event_id(F.col("ids"))).collect())
    assert a == b and len(a) == 19 and c == "ev-x"


def test_text_health_and_search(spark):
    filler = " and more visible text that fills the line up to forty characters"
    texts = [
        (1, "Same Line \n  same  line\n" * 3 + filler, "repetition", 78),
        (2, None, "", None),
        (3, 'He said "as is where is" basis', "near-empty", 40),
        (4, " \n\t", "", None),
        (5, "etc.\n" * 9 + filler, "", 100),  # too short a line to count
        (6, "the reserve price of " * 7 + filler, "repetition", 88),  # within a line; its run is 1
        (7, filler + "<table><tr><td>a", "truncated", 70),
        (8, filler + "<table><tr><td>a</td><td> </td><td></td></tr></table>\n", "truncated", 70),
        (9, filler + " <td", "truncated", 70),
        (10, filler + " " + ", ".join(map(str, range(7, 47))), "degenerate-sequence", 65),
        (11, filler + " " + ", ".join(map(str, range(7, 46))), "", 100),
        (12, "|".join(map(str, range(60))) + filler, "", 100),  # cells are no run
        (13, filler + " 07.35.4003 and 06.20.2024", "impossible-date", 75),
        (14, filler + " 06.20.2024 and 07.07.1962", "", 100),
        (15, filler + " &lt;|IM_end|&gt;", "token-leak", 60),
        (16, filler + " \u4e2d\u6587", "foreign-script", 60),
        (17, "head <TABLE><tr><td>" + "word " * 130 + "</td></tr></TABLE> tail", "repetition,table-collapse", 53),
        (18, "<table><tr><td>a few</td></tr></table>" + filler, "", 100),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id int, text string")
    got = {r["doc_id"]: (r["flags"], r["score"]) for r in T.health(df, "text").collect()}
    assert got == {i: (flags, score) for i, _, flags, score in texts}
    kept = spark.createDataFrame([(filler, "missing-region,token-leak"), (filler, "region-unverified"), (filler, None)], "text string, flags_before string")
    assert [(r["flags"], r["score"]) for r in T.health(kept, "text", "flags_before").collect()] == [("missing-region", 55), ("region-unverified", 100), ("", 100)]
    assert [r["doc_id"] for r in df.where(T.all_terms("text", 'basis "as is where"')).collect()] == [3]
    assert df.where(T.all_terms("text", "basis nothing")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"auction_id": "1", "v": 1}\n{"auction_id": "2", "v": 1}\n')
    (tmp_path / "b.jsonl").write_text('{"auction_id": "1", "v": 2}\n')
    assert {(r["auction_id"], r["v"]) for r in Ta.read_listing_files(spark, str(tmp_path / "*.jsonl")).collect()} == {("1", 2), ("2", 1)}
    (tmp_path / "m.csv").write_text("﻿Post ID, Impressions,Likes\np1,1000,50\np2,,x\n")
    assert {tuple(r) for r in Ta.read_post_metrics(spark, str(tmp_path / "m.csv"), ["impressions", "likes"]).collect()} == {("p1", 1000.0, 50.0), ("p2", 0.0, 0.0)}
    (tmp_path / "g.csv").write_text("Village Name,Sub-District\n Alpha , Beta\n")
    assert Ta.read_gazetteer(spark, str(tmp_path / "g.csv"), {"village": ["village name"], "taluk": ["taluk", "sub-district"], "pin": ["pincode"]}).first().asDict() == {"village": "Alpha", "taluk": "Beta", "pin": None}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in Ta.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r["k"] for r in Ta.unprocessed(new, old, "k").collect()} == {3}
    assert {r["k"] for r in Ta.unprocessed(new, old, "k", "v").collect()} == {2, 3}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("23-03-2026 0130 PM", "2026-03-23 13:30:00"), ("23-03-2026 130 PM", "2026-03-23 13:30:00"), ("01-01-2026 1200 AM", "2026-01-01 00:00:00"), ("01-01-2026 1215 pm", "2026-01-01 12:15:00"),
        ("2026-09-17T05:30:00.000Z", "2026-09-17 11:00:00"), ("2026-09-17T05:30:00+05:30", "2026-09-17 05:30:00"), ("2026-09-17T20:00:00-01:00", "2026-09-18 02:30:00"),
        ("15 Sep 2026 11:00", "2026-09-15 11:00:00"), ("12 Sep 2026", "2026-09-12 00:00:00"), ("1 September 2026 9:05", "2026-09-01 09:05:00"), ("12 Foo 2026", None),
        ("2026-09-15T11:00:00", "2026-09-15 11:00:00"), ("2026-09-15", "2026-09-15 00:00:00"), ("31-02-2026 1000 AM", None), ("N/A", None), ("--", None), ("", None), (None, None), ("soon", None),
    ],
)
def test_dates(spark, text, want):
    got = one(spark, N.parse_date, text)
    assert (got and str(got)) == want


@pytest.mark.parametrize(
    ("text", "value", "unit", "sqft"),
    [
        ("6.00 Cents", 6.0, "cent", 2613.6), ("2180 Sq. ft", 2180.0, "sq_ft", 2180.0), ("1080 1⁄2 sq.ft", 1080.5, "sq_ft", 1080.5), ("1931-1/4 sq.ft", 1931.25, "sq_ft", 1931.25), ("346.1/2 cents", 346.5, "cent", 150935.4),
        ("2 ½ acres", 2.5, "acre", 108900.0), ("½ ground", 0.5, "ground", 1200.0), ("0.11.50 Hectare (28 1/2 cents)", 0.115, "hectare", 12378.5), ("Hec. 3,06.0 (7.56 acres)", 3.06, "hectare", 329375.66),
        ("9.621 Acres (3-89-0 Hectares)", 9.621, "acre", 419090.76), ("1200 square feet", 1200.0, "sq_ft", 1200.0), ("1200 squareft", 1200.0, None, None), ("2 percent share", 2.0, None, None),
        ("1200 sft", 1200.0, "sq_ft", 1200.0), ("100 sq.mtrs", 100.0, "sq_m", 1076.39), ("1 ha", 1.0, None, None), ("1 hectare", 1.0, "hectare", 107639.1), ("no number", None, None, None),
    ],
)
def test_areas(spark, text, value, unit, sqft):
    got = one(spark, Ar.area, text)
    assert (got["unit"], got["value"], got["sqft"]) == (unit, pytest.approx(value), pytest.approx(sqft))


@pytest.mark.parametrize(
    ("text", "want"),
    [("0.10 1/4 acre (4625 Sq ft)", (4625.0, "stated")), ("7200 Sq. ft (each plot 1800 Sq. ft.)", (None, "multi_value")), ("5 cents and 7 sq.ft", (None, "composite")), ("3 cents", (1306.8, "converted")), ("some land", (None, "unparsed")), (None, (None, "unparsed"))],
)
def test_stated_sqft(spark, text, want):
    assert tuple(one(spark, Ar.stated_sqft, text)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sale Proclamation", "proclamation"), ("Terms and Conditions of E auction", "terms"), ("12345_20260817_Property-Details.pdf", "property_details"), ("Bidder Declaration.pdf", "affidavit"), ("BS-Chennai-Repco.pdf", "publication"),
        ("repco-hindu-chennai-12-09-2026.pdf", "publication"), ("The Hindu page 4", "publication"), ("Corrigendum to sale notice", "sale_notice"), ("Ravi Kumar Sale.pdf", "sale_notice"), ("NIT document", "tender"), ("photo", "unknown"), (None, "unknown"), ("", "unknown"),
    ],
)
def test_document_roles(spark, text, want):
    assert one(spark, N.document_role, text) == want


def test_compared_areas(spark):
    df = spark.createDataFrame([(1000.0, 1005.0), (1000.0, 10_100.0), (1000.0, 2000.0), (None, 1.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(Ar.compared_areas(F.col("a"), F.col("b"))).collect()] == ["agree", "magnitude_slip", "disagree", "unknown", "unknown"]
