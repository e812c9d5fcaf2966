"""Each pipeline stage against brute force on its own input."""

import pytest

import corpus_pipeline as cp
from lotwise.llm import line_dedup, packing
from lotwise.llm.shared import stored

from .helpers import components, without_repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), name.replace(" ", "-")))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "language ID", "line dedup", "n-gram Jaccard join", "best-fit packing"]


def test_filters_keep_clean_documents(spark, results):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = results[1].join(labels, "doc_id")
    good = results[0].join(labels.where("quality = 1"), "doc_id").count()
    assert kept.where("quality = 1").count() >= 0.95 * good
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    assert results[2].count() >= 0.98 * results[1].count()
    assert all(r.columns == cp.COLUMNS for r in results[:5])


def test_line_dedup_stage(results):
    before, after = texts(results[2]), texts(results[3])
    want = without_repeats(sorted(before.items()), line_dedup.MIN_WORDS)
    assert after == {d: t for d, t in want.items() if t == before[d] or t.strip(" \t\n\r\v\f")}
    assert {r["doc_id"]: r["n_chars"] for r in results[3].collect()} == {d: len(t) for d, t in after.items()}


def test_one_of_each_group_stays(results):
    before, after = texts(results[3]), texts(results[4])
    groups = components(sorted(before.items()))
    assert after == {d: before[d] for d in before if groups[d] == d}


def test_packing_stage(results):
    got = results[5].toPandas()
    assert set(got.doc_id) == set(texts(results[4]))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= packing.CAPACITY and s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]


def test_run_equals_the_stages(spark, results):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, SMALL).select(*columns).collect())) == sorted(map(tuple, results[5].select(*columns).collect()))
