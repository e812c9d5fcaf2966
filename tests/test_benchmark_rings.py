"""Every lot has its rows, as counted by brute force."""

import math
from bisect import bisect_left
from collections import defaultdict

import pytest

from lotwise.operators import analytics as A
from lotwise.plans import analytics_queries as plans
from lotwise.plans import registry

from .compare import rows, views

SMALL = "/root/testdata/sf0.001"
NAMES = ["key", "ring", "n", "p25", "median", "p75", "below", "percent_below"]


def quantile(values, q):
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def by_hand(subjects, peers, rings, least=5):
    out = {}
    for ring, by in rings.items():
        held = defaultdict(list)
        for p in peers:
            held[tuple(p[c] for c in by)].append(p["unit_price"])
        priced = {k: sorted(x for x in v if x is not None) for k, v in held.items()}
        for s in subjects:
            k = tuple(s[c] for c in by)
            if None in k or len(held[k]) < least:
                continue
            below = 0 if s["unit_price"] is None else bisect_left(priced[k], s["unit_price"])
            out[s["key"], ring] = (len(held[k]), *[quantile(priced[k], q) for q in (0.25, 0.5, 0.75)], below, 100 * below / len(held[k]))
    return out


def agree(got, want):
    found = got.select(*NAMES).collect()
    assert len(found) == len(want)
    assert {tuple(r)[:2] for r in found} == set(want)
    for r in found:
        assert [float(x) for x in tuple(r)[2:]] == pytest.approx(list(want[r["key"], r["ring"]]), abs=0.0051), r
        assert r["below"] == want[r["key"], r["ring"]][4]


def test_query_has_every_lot(spark):
    peers = [r.asDict() for r in plans._peers(spark, SMALL).collect()]
    agree(registry.QUERIES["benchmark_rings"](spark, SMALL), by_hand(peers, peers, plans._RINGS))


def test_ties_nulls_and_strangers(spark):
    schema = "key long, lot_type string, city string, unit_price double"
    peers = spark.createDataFrame([(i, "a" if i % 3 else None, "x", [1.0, 2.0, 2.0, 5.0, None][i % 5]) for i in range(17)] + [(90, "b", "y", 1.0)], schema)
    subjects = peers.unionByName(spark.createDataFrame([(100, "a", "x", 3.0), (101, "a", "x", 0.5), (102, "c", "z", 1.0), (103, "a", "x", None)], schema))
    rings = {"both": ["lot_type", "city"], "city": ["city"]}
    agree(A.benchmark_rings(subjects, peers, rings), by_hand([r.asDict() for r in subjects.collect()], [r.asDict() for r in peers.collect()], rings))


def test_rows_of_the_sql_are_among_them(spark):
    names, got = rows(registry.QUERIES["benchmark_rings"](spark, SMALL).toPandas())
    same, want = rows(views(SMALL).sql(registry.ORACLE_SQL["benchmark_rings"]).df())
    assert names == same and want and set(want) <= set(got)


def test_lots_are_joined_once_for_all_rings(spark):
    """Rings read the stored peers, not the tables that these come from."""
    plan = registry.QUERIES["benchmark_rings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "ring-subjects" in plan


def test_subjects_are_read_once_for_all_rings(spark):
    """Rings are told for kinds of subjects; the subjects themselves meet them in one join."""
    plan = registry.QUERIES["benchmark_rings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ring-subjects") == 1
