"""Queries whose SQL or result held on the small fixtures only, held against it on tables that show the difference."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lotwise.functions import descriptions as D
from lotwise.operators import linkage

from .compare import TABLES, assert_same, views

SMALL = "/root/testdata/sf0.001"


def changed(path, **tables):
    """A folder of the small tables with some of them put in another's place."""
    for t in TABLES:
        if t in tables:
            tables[t].coalesce(1).write.parquet(f"{path}/{t}.parquet")
        else:
            shutil.copy(f"{SMALL}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def same(spark, name, sf_dir):
    assert_same(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], views(sf_dir))


@pytest.mark.parametrize("key", [500, 1500, 4500, 9973500])
def test_areas_round_a_half_up(spark, key):
    text = F.lit(f"{key} sq.m")
    assert spark.range(1).select(D.areas(text)).first()[0] == [(key * 107639 + 500) // 1000 / 10]


def test_areas_of_long_figures(spark):
    assert spark.range(1).select(D.areas(F.lit("1" + "0" * 20 + " cents, 2 sq ft"))).first()[0] == [2.0, pytest.approx(4.356e22)]


def test_described_areas_of_halves(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet").limit(20).withColumn("p_partkey", (F.monotonically_increasing_id() + 1) * 500)
    same(spark, "described_areas", changed(tmp_path, part=part))


def test_guarded_query_is_whole(spark):
    same(spark, "guarded_query", "/root/testdata/sf0.1")


def test_dossier_answers_of_equal_windows(spark, tmp_path):
    said = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("license and version, license; version").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(38).alias("n_chars"))
    same(spark, "dossier_answers", changed(tmp_path, documents=said))


@pytest.mark.parametrize("n", [17, 18, 40])
def test_notice_tables_of_many_lots(spark, tmp_path, n):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    some = lines.limit(3 * n).withColumn("_i", F.monotonically_increasing_id())
    many = some.withColumns({"l_orderkey": 1_000_000_000 + F.col("_i") % 3, "l_linenumber": F.col("_i").cast("int")}).drop("_i")
    same(spark, "notice_table_grid", changed(tmp_path, lineitem=many.unionByName(lines.limit(300))))


def test_lots_in_a_tie_have_one_order(spark, tmp_path):
    tied = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(200)
    twice = tied.withColumn("l_returnflag", F.lit("B")).unionByName(tied.withColumn("l_returnflag", F.lit("A")))
    same(spark, "notice_table_grid", changed(tmp_path, lineitem=twice))


def test_reauction_pairs_are_of_all_rows(spark, tmp_path, monkeypatch):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    moved = lambda n: part.withColumn("p_partkey", F.col("p_partkey") + n)
    odd = part.limit(6).withColumns({"p_name": F.lit(None).cast("string"), "p_type": F.when(F.col("p_partkey") % 2 == 0, F.lit("!")).otherwise(F.col("p_type")), "p_size": F.lit(1), "p_brand": F.lit("Brand#1")})
    copies = part.unionByName(moved(1_000_000)).unionByName(moved(2_000_000)).unionByName(odd.withColumn("p_partkey", F.col("p_partkey") + 3_000_000))
    # one key twice, in two classes and in one
    copies = copies.unionByName(part.limit(5)).unionByName(part.limit(5).withColumn("p_type", F.lit("other")))
    sf_dir = changed(tmp_path, part=copies)
    monkeypatch.setattr(linkage, "MEMBERS", 2)
    same(spark, "reauction_pairs", sf_dir)
    # each row meets both its own copies
    own = entry.queries()["reauction_pairs"](spark, sf_dir).where("a % 1000000 = b % 1000000 AND b < 3000000 AND similarity = 1").select("a", "b").distinct()
    assert own.count() == 3 * part.count()
