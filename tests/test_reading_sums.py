"""Entities read the lots once; details are looked for in other descriptions only where their own lacks them."""

from lotwise.operators import readings as R
from lotwise.plans import reading_queries as plans

SMALL = "/root/testdata/sf0.001"


def test_lots_are_numbered_once(spark):
    entities, _ = plans._notices(spark, SMALL)
    assert "Window" not in entities._jdf.queryExecution().optimizedPlan().toString()


def test_described_and_echoed_areas(spark):
    own = ("full_description", None, None, None)
    rows = [
        (1, 1, *own, 0, 10), (1, 1, *own, 0, 10), (1, 2, *own, 5, 20), (1, 1, "property", "type", "Flat", None, 2, 4), (1, 1, "location", "p", "x", None, 6, 12), (1, 1, "boundary", "n", "x", None, 30, 40),
        (1, 1, "boundary", "n", "x", None, 30, 40), (1, 3, "property", "type", "Flat", None, 6, 9), (1, 3, "location", "p", "x", None, None, None), (2, 1, "property", "type", None, None, 1, 2),
        (1, 1, "extent", "uds_parent", None, 7.0, None, None), (1, 1, "extent", "total", None, 7.0, None, None), (1, 2, "extent", "uds_parent", None, 7.0, None, None), (1, 3, "extent", "extent", None, 7.0, None, None),
        (3, 1, *own, 500, 600), (3, 2, *own, 700, 800), (3, 1, "auction_terms", "reserve_price", None, 5e6, 90, 95), (3, 2, "auction_terms", "reserve_price", None, 5e6, 80, 85), (3, 3, "auction_terms", "reserve_price", None, 5e6, 10, 15),
    ]
    entities = spark.createDataFrame(rows, "notice long, lot int, cls string, kind string, value string, number double, start int, stop int")
    got = {tuple(r[c] for c in ("notice", "lot")): (r["short"], r["elsewhere"], r["bare"]) for r in R.described(entities).collect()}
    assert got == {(1, 1): (1, 1, False), (1, 3): (0, 1, True), (2, 1): (1, 0, True)}
    facts = {r["notice"]: r for r in R.notice_facts(entities, spark.createDataFrame([(n, 0) for n in (1, 2, 3, 4)], "notice long, markers int"), []).collect()}
    assert {n: (r["parent_as_own"], r["crossed"]) for n, r in facts.items()} == {1: (1, False), 2: (0, False), 3: (0, True), 4: (0, False)}
