"""A text that many rows share is read once, and all its rows count."""

from lotwise.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_stated_areas_reads_each_text_once(spark):
    found = registry.QUERIES["stated_areas"](spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_" in plan and "regexp_" not in plan[plan.index("\n", plan.rindex("aggregate [")) :]  # below the first grouping
    assert sum(r["n"] for r in found.collect()) == spark.read.parquet(f"{SMALL}/part.parquet").count()
