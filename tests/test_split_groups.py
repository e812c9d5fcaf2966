"""Operators whose groups may hold a third of all rows: ranges, ranks, first mentions and size bands."""

import random

from pyspark.sql import functions as F

from lotwise.operators import analytics as A
from lotwise.operators import resolution as R
from lotwise.operators import text as T


def test_counted_before_splits_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 50), i, rng.choice([1, 2, 5])) for i in range(3000)] + [(None, 3, -1, 1)]
    df = spark.createDataFrame(rows, "g string, v int, k int, n int").repartition(9)
    got = {r["k"]: (r["_before"], r["_total"]) for r in A.counted_before(df, "g", ["v", "k"], "n").collect()}
    want = {}
    for g, v, k, _ in rows:
        own = [r for r in rows if r[0] == g]
        want[k] = (sum(r[3] for r in own if (r[1], r[2]) < (v, k)), sum(r[3] for r in own))
    assert got == want
    assert A.counted_before(df.where("false"), "g", ["v", "k"]).count() == 0


def test_spearman_with_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b"]), rng.randint(0, 9), rng.choice([None, 1.0, 2.0, 3.5])) for _ in range(600)]
    got = {r["g"]: (r["n"], r["rho"]) for r in A.spearman(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", "g").collect()}
    for g in "ab":
        own = [(x, y) for h, x, y in rows if h == g and y is not None]

        def ranks(values):
            return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

        x, y = ranks([p[0] for p in own]), ranks([p[1] for p in own])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        rho = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
        assert got[g][0] == len(own)
        assert abs(got[g][1] - rho) <= 1e-4


def test_first_mentions(spark):
    rows = [("t", 0, "user", "Ask Ann"), ("t", 1, "assistant", "Ann met Bob"), ("t", 2, "assistant", "Bob and Cy"), ("t", 3, "assistant", None), ("u", 0, "assistant", "Bob")]
    df = spark.createDataFrame(rows, "c string, i int, role string, text string")
    got = {(r["c"], r["i"]): (r["n_new"], r["new_names"]) for r in R.first_mentions(df, "c", "i", F.col("role") == "assistant", "text", "([A-Z][a-z]+)").collect()}
    assert got == {("t", 1): (1, "Bob"), ("t", 2): (1, "Cy"), ("t", 3): (0, ""), ("u", 0): (1, "Bob")}


def test_near_duplicates_across_size_bands(spark):
    rng = random.Random(7)
    base = [f"word{i}" for i in range(60)]
    texts = [" ".join(base + [f"extra{j}{i}" for i in range(j)]) for j in range(12)] + [" ".join(rng.sample(base, 55)) for _ in range(8)]
    got = {(r["a"], r["b"]) for r in T.near_duplicate_texts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", 0.9).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.9 and texts[i] != texts[j]}
    assert got == want and len(want) > 10
