"""Readers of the star tables and of the listing formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing view: one row per order with its place, category, bidder and source rank.

    Dimension tables are joined on their keys; Catalyst prunes those columns,
    and so those scans, that a query does not use.
    """
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("o_orderkey").alias("listing_id"),
            F.col("o_custkey").alias("borrower_id"),
            F.col("c_name").alias("borrower"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("c_mktsegment").alias("category"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("reserve"),
            F.col("o_orderdate").alias("auction_dt"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("source_rank"),
        )
    )


#: The same view for the SQL oracle, as the start of a WITH list.
LISTINGS_SQL = """WITH listings AS (
  SELECT o_orderkey AS listing_id, o_custkey AS borrower_id, c_name AS borrower, n_name AS city, r_name AS state, c_mktsegment AS category,
    o_orderstatus AS status, o_totalprice AS reserve, o_orderdate AS auction_dt, CAST(substr(o_orderpriority, 1, 1) AS INT) AS source_rank
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("lot_no", F.row_number().over(order))


def lot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id and lot_no of the lot view; as p_partkey is a key of part, the join with it adds nothing here."""
    return _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("listing_id"), "lot_no")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lot view: a row per lineitem with a key of its own, as (order, line number) repeats."""
    numbered, part = _numbered(spark, sf_dir), table(spark, sf_dir, "part")
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("listing_id"),
        "lot_no",
        F.col("l_suppkey").alias("bank_id"),
        F.col("p_type").alias("lot_type"),
        F.col("l_extendedprice").alias("lot_reserve"),
        F.col("l_quantity").alias("extent"),
        F.col("l_shipdate").alias("deadline"),
        F.col("l_returnflag").alias("possession"),
    )


LOTS_SQL = """lots AS (
  SELECT l_orderkey AS listing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) AS lot_no,
    l_suppkey AS bank_id, p_type AS lot_type, l_extendedprice AS lot_reserve, l_quantity AS extent, l_shipdate AS deadline, l_returnflag AS possession
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
)"""


def read_listing_files(spark: SparkSession, path: str, key: str = "auction_id") -> DataFrame:
    """JSON-lines listing files; of rows with one key, that of the file whose name sorts last wins."""
    rows = spark.read.json(path).withColumn("_file", F.input_file_name())
    newest = Window.partitionBy(key).orderBy(F.desc("_file"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_file")


def read_post_metrics(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV of post metrics: header names lower-cased and trimmed, a byte-order mark dropped, blanks and junk in number columns as 0."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[c.replace("﻿", "").strip().lower().replace(" ", "_") for c in raw.columns])
    return named.select(*[F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)"), F.lit(0.0)).alias(c) if c in numbers else F.col(c) for c in named.columns])


def read_gazetteer(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV whose columns go by several names: each wanted column takes the first alias that the header has."""
    raw = spark.read.option("header", True).csv(path)
    held = {c.strip().lower(): c for c in raw.columns}
    found: dict[str, Column] = {}
    for want, names in aliases.items():
        hit = next((held[n] for n in names if n in held), None)
        found[want] = F.trim(F.col(f"`{hit}`")) if hit else F.lit(None).cast("string")
    return raw.select(*[c.alias(n) for n, c in found.items()])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keyed overwrite: rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def unless_corrected(old: DataFrame, new: DataFrame, key: str, value: str, corrected: str) -> DataFrame:
    """Upsert one value column, except where the old row has been corrected by hand."""
    o, n = old.alias("o"), new.select(key, F.col(value).alias("_new")).alias("n")
    both = o.join(n, key, "full_outer")
    keep = F.col(corrected).isNotNull() | F.col("_new").isNull()
    return both.select(key, F.when(keep, F.col(value)).otherwise(F.col("_new")).alias(value), corrected)


def unprocessed(rows: DataFrame, done: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Incremental selection: rows with no artefact yet, or whose artefact was made from another version."""
    if version is None:
        return rows.join(done, key, "left_anti")
    return rows.join(done.select(key, version), [key, version], "left_anti")
