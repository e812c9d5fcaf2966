"""Single notices by hand: what each key decides, rivals, claims and the last lot."""

import pytest

from lotwise.operators import evidence as E

LISTING = "doc int, listing string, price double, emd double, borrowers array<string>, ids array<string>"
LOT = "doc int, lot int, reserve double, emd double, borrowers array<string>, ids array<string>, portal_aid string"


def judged(spark, listings, lots):
    told = spark.createDataFrame([(1, *r) for r in listings], LISTING)
    sold = spark.createDataFrame([(1, *r) for r in lots], LOT)
    return {r["listing"]: (r["outcome"], r["tier"], r["lot"], r["rivals"]) for r in E.explained(E.evidence(told, sold)).collect()}


APART = [(1, 100.0, 10.0, ["ravi"], ["1a", "s"], None), (2, 200.0, 20.0, ["devi"], ["2a", "s"], None)]
ALIKE = [(1, 100.0, 10.0, ["ravi"], ["1a", "s"], None), (2, 100.0, 10.0, ["devi"], ["2a", "s"], None), (3, 100.0, 10.0, None, None, None)]


@pytest.mark.parametrize(
    ("listings", "lots", "want"),
    [
        ([("a", 100.0, None, None, None), ("b", 200.9, None, None, None)], APART, {"a": ("linked", "exact", 1, ""), "b": ("linked", "tolerance", 2, "")}),
        ([("a", None, 20.1, None, None)], APART, {"a": ("linked", "emd_tolerance", 2, "")}),
        ([("a", 100.0, None, ["devi", "x"], None), ("b", 100.0, None, None, ["1a"]), ("c", 100.0, 10.0, None, ["s"])], ALIKE, {"a": ("linked", "borrower", 2, ""), "b": ("linked", "identifier", 1, ""), "c": ("unmatched", "ambiguous", None, "")}),
        ([("a", 100.0, None, None, None), ("b", 100.5, None, None, None)], APART, {"a": ("rival", "exact", 1, "b"), "b": ("rival", "tolerance", 1, "a")}),
        ([("a", 100.0, None, None, None), ("b", 555.0, None, None, None)], APART, {"a": ("linked", "exact", 1, ""), "b": ("linked", "remainder", 2, "")}),
        ([("a", 444.0, None, None, None), ("b", 555.0, None, None, None)], APART, {"a": ("unmatched", "none", None, ""), "b": ("unmatched", "none", None, "")}),
        ([("a", None, None, None, ["1a"])], APART, {"a": ("unmatched", "no_listing_price", None, "")}),
        ([("a", 7.0, None, None, None), ("b", None, None, None, None)], APART[:1], {"a": ("linked", "single", 1, ""), "b": ("linked", "single", 1, "")}),
    ],
)
def test_keys(spark, listings, lots, want):
    assert judged(spark, listings, lots) == want


def test_claims_are_checked(spark):
    claimed = [(*lot[:5], aid) for lot, aid in zip(ALIKE, ["a", "b", "b"], strict=True)]
    got = judged(spark, [("a", 100.0, None, None, None), ("b", 100.0, None, None, None)], claimed)
    assert got == {"a": ("linked", "portal_aid", 1, ""), "b": ("unmatched", "ambiguous", None, "")}  # two lots claim b
    against = [(*APART[0][:5], "b"), (*APART[1][:5], None)]
    assert judged(spark, [("b", 200.0, None, None, None), ("c", None, None, None, None)], against)["b"] == ("unmatched", "portal_aid_conflict", None, "")
    assert judged(spark, [("b", None, None, None, None)], against)["b"] == ("linked", "portal_aid", 1, "")


def test_every_refused_pair_has_its_key(spark):
    told = spark.createDataFrame([(1, "a", 100.0, None, ["devi"], None)], LISTING)
    rows = {r["lot"]: r["refused_by"] for r in E.evidence(told, spark.createDataFrame([(1, *lot) for lot in [*ALIKE, (4, 300.0, 30.0, None, None, None)]], LOT)).collect()}
    assert rows == {1: "borrower", 2: None, 3: "borrower", 4: "price"}
    assert E.explained(E.evidence(told.where("doc < 0"), spark.createDataFrame([], LOT))).count() == 0


def test_pairs_are_not_sorted(spark):
    told, sold = spark.createDataFrame([], LISTING), spark.createDataFrame([], LOT)
    plan = E.evidence(told, sold)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # the claims, before listings meet lots


def test_explanations_without_pairs(spark):
    claimed = [(*lot[:5], aid) for lot, aid in zip(ALIKE, ["a", "b", "b"], strict=True)]
    told = [(1, "a", 100.0, None, None, None), (1, "b", 100.0, None, None, ["2a"]), (2, "c", 100.0, None, None, None), (2, "d", 555.0, None, None, None), (3, "e", 100.2, None, None, None), (3, "f", 100.0, None, None, None)]
    listings, lots = spark.createDataFrame(told, LISTING), spark.createDataFrame([*[(1, *x) for x in claimed], *[(d, *x) for d in (2, 3) for x in APART]], LOT)
    want = E.explained(E.evidence(listings, lots)).collect()
    assert sorted(E.explanations(listings, lots).collect()) == sorted(want) and len(want) == 6
