"""The stored index gives what a search through the texts gives, also after more documents."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import postings as P
from lotwise.operators import text as T
from lotwise.sources.tables import table

ODD = [None, "", " ", "A b-a", "version 2.0", "Version 2 0 x", "version x 2.0", "2.0 version", "é1é word", "İstanbul Kelvin", "a" * 70_000, "word " * 50_000, "version 2.0 " * 3]


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(8)
    words = ["license", "version", "2", "0", "public", "mit", "work", "apache", *(f"w{i}" for i in range(60))]
    texts = [*ODD, *(" ".join(random.choices(words, k=random.randrange(80))) + random.choice(["", " version 2.0", " License"]) for _ in range(300))]
    keys = [i * 37 for i in range(len(texts))]  # over several buckets
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in zip(keys, texts, strict=True)] + [(None, "license", "c", 1), (keys[4], "version 2.0", "c", 2)], "doc_id long, text string, term string, bucket int")


@pytest.fixture(scope="module", params=[1, 3])
def index(spark, rows, request, tmp_path_factory):
    """Built in one segment, or in three of which each run is given all that the runs before it had."""
    found = P.TextIndex(spark, "file://" + str(tmp_path_factory.mktemp("index") / str(request.param)))
    for n in range(request.param):
        assert found.add(rows.where(F.col("doc_id").isNull() | (F.pmod("doc_id", F.lit(request.param)) <= n)), "doc_id", "text") == n
    return found


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_segments_hold_every_document_once(index, rows):
    assert ids(index.read("lengths").select("doc")) == ids(rows.where("doc_id IS NOT NULL").select("doc_id").distinct())
    postings = index.read("postings").select("term", F.inline("held"))
    assert postings.count() == postings.select("term", "doc").distinct().count()


@pytest.mark.parametrize("query", ["license", "license public", "zzz license", "mit work apache", "w1 w2 w3"])
def test_words(index, rows, query):
    texts = rows.where("doc_id IS NOT NULL")
    assert ids(index.all_of(query)) == ids(texts.where(T.all_terms("text", query)).select("doc_id").distinct())
    assert ids(index.any_of(query)) == ids(texts.where(T.any_term("text", query)).select("doc_id").distinct())


@pytest.mark.parametrize("query", ['"version 2.0"', 'license "version 2.0"', '"w1 w2" w3', '"public public"'])
def test_phrases(index, rows, query):
    texts = rows.where("doc_id IS NOT NULL").withColumn("plain", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" ")))
    parts = query.split('"')
    wanted = [" ".join(P.tokens(p)) for p in parts[1::2]] + [w for p in parts[0::2] for w in P.tokens(p)]
    for w in wanted:
        texts = texts.where(F.col("plain").contains(f" {w} "))
    assert ids(index.all_of(query)) == ids(texts.select("doc_id").distinct())


def test_scores(index, rows):
    texts = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).na.fill("", ["text"])
    want = {r["doc_id"]: r["score"] for r in T.bm25(texts, "doc_id", "text", ["license", "mit", "zzz"]).collect()}
    got = {r["doc"]: r["score"] for r in index.bm25(["license", "mit", "zzz"]).collect()}
    assert got == pytest.approx(want) and got


def test_only_a_query_s_terms_are_read(index):
    plan = index.bm25(["license"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [license])]" in plan or "EqualTo(term,license)" in plan
    assert "text" not in [c for c in index.read("postings").columns]


def test_an_unfinished_segment_is_not_read(spark, rows, tmp_path):
    found = P.TextIndex(spark, "file://" + str(tmp_path))
    found.add(rows, "doc_id", "text")
    before = found.read("lengths").count()
    (tmp_path / "lengths" / "segment=1").mkdir()
    rows.select(F.col("doc_id").alias("doc"), F.lit(1).cast("long").alias("words")).write.mode("overwrite").parquet(str(tmp_path / "lengths" / "segment=1"))
    assert found.read("lengths").count() == before and found.add(rows, "doc_id", "text") == 1
    assert found.read("lengths").count() == before


def test_empty_index(spark, tmp_path):
    found = P.TextIndex(spark, "file://" + str(tmp_path))
    assert found.all_of("a b").count() == found.any_of("a").count() == found.bm25(["a"]).count() == 0


def test_places_are_read_for_phrases_only(index):
    read = [f(q)._jdf.queryExecution().executedPlan().toString() for f, q in ((index.any_of, "license public"), (index.all_of, "license mit"), (index.all_of, '"version 2.0"'))]
    assert ["places:array<int>" in plan for plan in read] == [False, False, True]
    assert "places:array<int>" not in index.bm25(["license"])._jdf.queryExecution().executedPlan().toString()


def test_a_row_of_postings_is_flat_and_whole(index, rows):
    """The stored arrays say the same as the postings that are read."""
    for r in index.packed("postings").collect():
        assert len(r["docs"]) == len(r["ends"]) and r["ends"][-1] == len(r["places"]) and list(r["ends"]) == sorted(set(r["ends"]))
    words = {r["doc"]: r["words"] for r in index.read("lengths").collect()}
    held = index.read("postings").select("term", F.inline("held")).groupBy("doc").agg(F.sum(F.size("places")).alias("n"), F.max(F.array_max("places")).alias("last")).collect()
    assert {r["doc"]: r["n"] for r in held} == {r["doc"]: r["last"] + 1 for r in held} == {d: n for d, n in words.items() if n}
