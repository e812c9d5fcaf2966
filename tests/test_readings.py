"""Checks, anchors and comparisons of readings on small rows."""

from pyspark.sql import functions as F

from lotwise.operators import readings as R

ENTITY = "notice int, cls string, lot int, kind string, value string, number double, start int, stop int"


def issues(spark, rows, markers=0):
    entities = spark.createDataFrame(rows, ENTITY)
    notices = spark.createDataFrame([(1, markers)], "notice int, markers int")
    return tuple(R.notice_issues(R.notice_facts(entities, notices, ["patta"])).first())[1:]


WHOLE = [
    (1, "secured_creditor", 1, "legal_basis", "SARFAESI", None, 0, 5),
    (1, "full_description", 1, None, "text", None, 10, 90),
    (1, "property", 1, None, "house", None, 11, 15),
    (1, "borrower", 1, None, "a", None, 100, 110),
    (1, "location", 1, None, "b", None, 20, 30),
    (1, "extent", 1, "extent", None, 900.0, 31, 35),
    (1, "auction_terms", 1, "reserve_price", None, 2e6, 120, 130),
]


def test_whole_and_empty_notices(spark):
    assert issues(spark, WHOLE) == ("", 100)
    codes, score = issues(spark, [r for r in WHOLE if r[0] == 2], markers=3)
    assert score == 0 and codes == "legal_basis_bad,lot_under_recall,missing_borrower,missing_extent,missing_location,missing_reserve_price,missing_secured_creditor"


def test_details_and_descriptions(spark):
    second = [(1, c, 2, k, v, n, a + 200, b + 200) for _, c, _, k, v, n, a, b in WHOLE if c != "secured_creditor"]
    assert issues(spark, WHOLE + second) == ("", 100)
    moved = [(*r[:6], 22, 28) if r[1] == "location" else r for r in second]  # in the first lot's description
    assert issues(spark, WHOLE + moved) == ("detail_wrong_lot", 90)
    outside = [(*r[:6], 400, 410) if r[1] == "location" else r for r in second]
    assert issues(spark, WHOLE + outside) == ("full_description_incomplete", 80)
    assert issues(spark, WHOLE + [r for r in second if r[1] != "full_description"]) == ("missing_full_description", 70)
    crossed = [(*r[:6], 5, 8) if r[1] == "auction_terms" else r for r in second]
    assert issues(spark, WHOLE + crossed) == ("lot_pairing_off", 90)
    assert issues(spark, WHOLE + [(*r[:6], None, None) if r[1] == "borrower" else r for r in second]) == ("ungrounded", 90)  # 1 of 13
    assert issues(spark, [(*r[:4], "null", r[5], None, None) if r[1] == "borrower" else r for r in WHOLE]) == ("null_value,ungrounded", 86)  # 1 of 7
    assert issues(spark, WHOLE + [(1, "identifier", 1, "colour", "1", None, 40, 41)]) == ("kind_invalid", 96)
    flat = [(*r[:4], "flat", *r[5:]) if r[1] == "property" else r for r in WHOLE]
    assert issues(spark, flat) == ("missing_uds", 80)
    parent = [(1, "extent", 1, "uds", None, 10.0, 40, 41), (1, "extent", 1, "uds_parent", None, 900.0, 42, 43)]
    assert issues(spark, flat + parent) == ("uds_parent_as_own_area", 80)


def test_reanchored_ties_and_orphans(spark):
    schema = "doc int, id int, cls string, lot int, start int, stop int, text string"
    old = spark.createDataFrame([(1, 1, "description", 1, 0, 100, "land"), (1, 2, "borrower", 1, 110, 130, "Kumar"), (1, 3, "borrower", 9, 900, 910, "nobody"), (2, 1, "borrower", 1, 0, 5, None)], schema)
    new = spark.createDataFrame([(1, 11, "description", 4, 10, 110, "land"), (1, 12, "borrower", 4, 300, 320, "Kumar"), (1, 13, "borrower", 4, 200, 220, "Kumar"), (1, 14, "borrower", 5, 111, 131, "Other")], schema)
    got = {(r["doc"], r["id"]): r["anchor"] for r in R.reanchored(old, new).collect()}
    assert got == {(1, 1): "11", (1, 2): "13", (1, 3): "orphaned:3", (2, 1): "orphaned:1"}


def test_rulings_join_transitively(spark):
    from lotwise.sources.scratch import stored

    groups = spark.createDataFrame([(1, 2, "b"), (2, 2, "a"), (3, 1, "long name"), (4, 5, "z")], "id int, n int, label string")
    proposals = spark.createDataFrame([(1, 2), (3, 4), (2, 4)], "a int, b int")
    rulings = spark.createDataFrame([(2, 1, True), (2, 3, True), (4, 3, False)], "a int, b int, approved boolean")
    after, left = R.merged_by_rulings(groups, proposals, rulings, stored)
    assert {tuple(r) for r in after.select("id", "n", "label", "members").collect()} == {(1, 5, "a", 3), (4, 5, "z", 1)}
    assert [tuple(r) for r in left.collect()] == [(2, 4)]


def test_tokens_amounts_and_labels(spark):
    one = spark.range(1)
    words = one.select(R.name_words(F.lit("M/s. Sri Kumaran Textiles & Co")).alias("a"), R.name_words(F.lit("KUMARANS")).alias("b"), R.name_words(F.lit(None).cast("string")).alias("c"))
    assert words.first()["a"] == ["kumaran", "textiles"] and words.first()["c"] == []
    assert tuple(words.select(R.names_meet(F.col("a"), F.col("b")), R.names_meet(F.col("a"), F.col("c"))).first()) == (True, False)
    assert one.select(R.id_words(F.lit("S.F.No. 12/3A2, 1200 Sq.ft, 2.5 cents, year 1998, loan 1234567"))).first()[0] == ["sz:1200", "sz:2.5", "12/3a2"]
    grounds = [one.select(R.amount_grounds(F.lit(x), F.array(F.lit(2_345_678.0)))).first()[0] for x in (2_345_678.0, 2_300_000.0, 2_346_000.0, 2_350_001.0, 9.0)]
    assert grounds == ["equal", "rounded", "rounded", "near", "loose"]
    pages = spark.createDataFrame([("<tr><td>A:</td><td>1 <i>x</i></td></tr><dl><dt>B</dt><dd></dd></dl><tr><td>only</td></tr>",), (None,), ("",)], "html string")
    assert [[tuple(p) for p in r[0]] for r in pages.select(R.label_values("html")).collect()] == [[("A", "1 x"), ("B", "")], [], []]


def test_each_pair_of_texts_is_scored_once():
    import pandas as pd

    from lotwise.functions import similarity as S

    calls = []
    scored = S._scores(lambda x, y: calls.append((x, y)) or 50, pd.Series(["a", "a", None, "b"]), pd.Series(["x", "x", "x", "x"]))
    assert calls == [("a", "x"), ("b", "x")] and scored.dropna().tolist() == [50, 50, 50]


def test_reanchored_joins_the_lots_once(spark, sf_dir):
    from lotwise.plans import registry

    plan = registry.QUERIES["reanchored"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("ArrowEvalPython") <= 2


def test_details_are_gathered_once(spark):
    entities = spark.createDataFrame([(1, c, lot, None, None, None, a, b) for c, lot, a, b in [("full_description", 1, 0, 90), ("extent", 1, 5, 9), ("location", 1, 95, 99), ("extent", 2, 10, 20), ("location", 2, 200, 210), ("extent", None, 10, 20)]], ENTITY)
    got = R.described(entities)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 0, False), (1, 2, 1, 1, True), (1, None, 1, 0, True)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan")].count("partial_collect_set") == 1
