"""Resolution, identifier and grounding queries over the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures as M
from ..operators import resolution as R
from ..sources.tables import LISTINGS_SQL, listings, table

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT o_orderkey, CASE o_orderpriority[1:1] WHEN '1' THEN 'CONFIRMED' WHEN '2' THEN 'CONFIRMED' WHEN '3' THEN 'PROBABLE' WHEN '4' THEN 'INFERRED' ELSE 'UNKNOWN' END AS confidence FROM orders")
def link_confidence(spark, sf_dir):
    method = F.create_map(*(F.lit(x) for x in ("1", "human", "2", "four_field", "3", "unit", "4", "borrower")))
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", R.confidence(F.coalesce(F.try_element_at(method, rank), F.lit("none"))).alias("confidence"))


@query("WITH n AS (SELECT DISTINCT p_type AS name, list_sort(list_distinct(regexp_split_to_array(lower(p_type), '\\s+'))) AS w FROM part UNION SELECT DISTINCT replace(p_type, 'E', 'F'), list_sort(list_distinct(regexp_split_to_array(lower(replace(p_type, 'E', 'F')), '\\s+'))) FROM part), d AS (SELECT name, word, array_to_string(list_filter(w, lambda x: x <> word), ' ') AS rest FROM (SELECT name, w, unnest(w) AS word FROM n)) SELECT DISTINCT a.name AS a, b.name AS b FROM d a JOIN d b ON a.rest = b.rest AND a.name < b.name AND a.word <> b.word WHERE damerau_levenshtein(a.word, b.word) <= 2 AND damerau_levenshtein(a.word, b.word) <= 0.3 * greatest(length(a.word), length(b.word))")
def ocr_name_variants(spark, sf_dir):
    """Part types against themselves with one letter misread."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    return R.ocr_variants(types.unionByName(types.select(F.replace("name", F.lit("E"), F.lit("F")).alias("name"))), "name")


@query("WITH h AS (SELECT c_custkey, c_nationkey AS place FROM customer UNION ALL SELECT o_custkey, s_nationkey FROM (SELECT o_custkey, min(l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) JOIN supplier ON s_suppkey = s), a AS (SELECT c_custkey, min(place) AS place, count(*) AS hints FROM h WHERE place IS NOT NULL GROUP BY 1 HAVING count(DISTINCT place) = 1) SELECT c_custkey, place, coalesce(hints, 0) AS hints FROM customer LEFT JOIN a USING (c_custkey)")
def hinted_places(spark, sf_dir):
    """A place from two hints, which cancel where they differ."""
    customer = table(spark, sf_dir, "customer")
    first = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("l_suppkey").alias("s"))
    second = first.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("s")).select("c_custkey", F.col("s_nationkey").alias("place"))
    return R.hinted(customer.select("c_custkey"), "c_custkey", [customer.select("c_custkey", F.col("c_nationkey").alias("place")), second], "place")


@query("SELECT k AS listing_id, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM (SELECT l_orderkey AS k, 'lot' AS path FROM lineitem WHERE l_partkey = 17 UNION ALL SELECT o_orderkey, 'parcel' FROM orders WHERE o_custkey = 17) GROUP BY k")
def find_by_identifier(spark, sf_dir):
    lots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_partkey").alias("value"))
    parcels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("value"))
    return R.find_identifier(lots, parcels, " 17", "listing_id", "value")


@query("WITH t AS (SELECT conv_id, turn, role, text, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations), f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+)', 1)) AS s, list_distinct(regexp_extract_all(coalesce(before, ''), '([A-Z][a-z]+)', 1)) AS b FROM t WHERE role = 'assistant') SELECT conv_id, turn, len(list_filter(s, lambda x: NOT list_contains(b, x))) AS n_new, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(b, x))), ',') AS new_names FROM f")
def answer_grounding(spark, sf_dir):
    """Names in an answer that nothing said before it in the thread holds."""
    return R.first_mentions(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant", "text", "([A-Z][a-z]+)")


@query("WITH p AS (SELECT conv_id AS grp, role AS copy, turn, text AS c FROM conversations), s AS (SELECT grp, copy, list(c ORDER BY turn, c) AS o FROM p GROUP BY 1, 2) SELECT grp, max(len(o)) AS pages, count(*) AS copies, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT o) = 1 THEN 'agreed' ELSE 'ambiguous' END AS verdict FROM s GROUP BY grp")
def page_order(spark, sf_dir):
    """Whole texts, by their digests, so that a long thread is gathered in few bytes a turn."""
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grp"), F.col("role").alias("copy"), "turn", F.sha2("text", 256).alias("c"))
    return R.page_groups(p, "grp", "turn", "c").withColumn("pages", F.col("pages").cast("long"))


@query("WITH f AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '\\b([0-9]{2,5})\\b', 1), lambda v: NOT regexp_matches(v, '^(19|20)[0-9]{2}$'))) AS ids FROM documents) SELECT doc_id, len(ids) AS n, list_min(ids) AS least FROM f WHERE len(ids) > 0")
def numbers_in_text(spark, sf_dir):
    ids = M.loose_ids(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids).cast("long").alias("n"), F.array_min(ids).alias("least")).where("n > 0")


@query(f"{LISTINGS_SQL} SELECT w.user_id, listing_id, auction_dt, CAST(row_number() OVER (PARTITION BY w.user_id ORDER BY auction_dt, listing_id) AS INT) AS position FROM (SELECT DISTINCT user_id, event_id AS watched FROM events WHERE event_type = 'purchase') w JOIN listings ON listing_id = watched WHERE auction_dt >= TIMESTAMP '1997-01-01'")
def watchlist_deadlines(spark, sf_dir):
    watched = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("listing_id")).distinct()
    rows = watched.join(listings(spark, sf_dir), "listing_id").where(F.col("auction_dt") >= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))
    return rows.select("user_id", "listing_id", "auction_dt", F.row_number().over(Window.partitionBy("user_id").orderBy("auction_dt", "listing_id")).alias("position"))
