"""Every query with SQL gives the SQL's rows; the others give rows of a stable schema."""

import pytest

import __spark_entry__ as entry
from lotwise.plans import registry

from .compare import assert_same, views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
