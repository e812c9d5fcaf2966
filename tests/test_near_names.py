"""Many pairs of names are scored together as each alone."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.functions.similarity import indel_ratio, indel_ratios, ratio
from lotwise.operators import places


def test_pairs_scored_together():
    random.seed(4)
    texts = ["", "a", "a" * 64, "b" * 65, "x" * 300, "a\0", "é" * 64, *("".join(random.choices("abcdé ", k=random.randrange(90))) for _ in range(100))]
    a, b = (random.choices(texts, k=3000) for _ in range(2))
    assert indel_ratios(a, b).tolist() == [indel_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert indel_ratios([], []).tolist() == []


def test_column_scores_many_pairs_and_nulls():
    given = pd.Series(["ab", None, "ab", "", "x"]), pd.Series(["abc", "a", None, "", "x"])
    got = ratio.func(*given)
    assert got.isna().tolist() == [False, True, True, False, False] and got.dropna().tolist() == [80.0, 100.0, 100.0]


@pytest.mark.parametrize("least", [83.0, 86.0, 100.0])
def test_near_pairs_are_found_and_few_others_scored(spark, monkeypatch, least):
    random.seed(5)
    texts = {"".join(random.choices("bdklmnrs", k=random.randrange(8, 16))) for _ in range(150)} | {"a" * 9, "a" * 12, "x1é2", "x1é", "7" * 70}
    texts |= {t[: len(t) // 2] + random.choice("ahz9é") + t[len(t) // 2 + random.randrange(2) :] for t in texts}
    names = spark.createDataFrame([("s", t) for t in sorted(texts)], "scope string, k string")
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series(indel_ratios(a.tolist(), b.tolist()))

    monkeypatch.setattr(places, "ratio", counted)
    got = {(r["k"], r["key"]) for r in places.close(names, names.select("scope", F.col("k").alias("key"), F.col("k").alias("answer")), least).collect()}
    assert got == {(a, b) for a in texts for b in texts if indel_ratio(a, b) >= least}
    assert len(got) <= scored.value < len(texts) ** 2 / 4


def test_keys_are_made_of_distinct_names(spark):
    rows = spark.range(0, 5000, 1, 5).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("Name "), (F.col("id") % 10).cast("string"))).alias("v"))
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def key(v: pd.Series) -> pd.Series:
        made.add(len(v))
        return v.str.lower()

    got = places.with_keys(rows, {"v": {"k": key.asNondeterministic()(F.col("_said"))}})
    assert got.where("k IS NOT NULL").groupBy("k").count().count() == 9
    assert made.value == 9
    assert got.count() == 5000
