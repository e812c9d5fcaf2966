"""Pairs that share groups: counts by hand, and tasks by the rows."""

from lotwise.operators import analytics as A


def test_pairs_are_counted_once_a_group_and_dealt_by_rows(spark):
    rows = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (2, 7), (2, 9), (3, 9), (None, 7), (None, 8), (4, None), (4, 7)], "g long, m long")
    got = A.shared_groups(rows, "g", "m")
    assert {tuple(r) for r in got.collect()} == {(7, 8, 2), (7, 9, 1), (8, 9, 1)}
    spread = A.shared_groups(rows, "g", "m", per_task=1)
    assert spread.rdd.getNumPartitions() == 11
    assert sorted(spread.collect()) == sorted(got.collect())
