"""Queries on readings of notices over the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readings as R
from ..sources.scratch import stored
from ..sources.tables import LISTINGS_SQL, LOTS_SQL, listings, lots, table

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# The entities of each notice, made from its lots: every lot has a stretch of a
# thousand characters, and what is missing or misplaced follows from the keys.
# Both engines read this text, {lots} and {orders} being the tables.
_ENTITIES = """
SELECT listing_id AS notice, 'full_description' AS cls, lot_no AS lot, 'text' AS kind, 'as read' AS value, CAST(0 AS DOUBLE) AS number, lot_no * 1000 AS start, lot_no * 1000 + 500 AS stop FROM {lots} WHERE (listing_id + lot_no) % 12 <> 0
UNION ALL SELECT listing_id, 'property', lot_no, 'type', CASE WHEN lot_no % 5 = 4 THEN NULL WHEN lot_no % 2 = 1 THEN 'Flat' ELSE 'House' END, NULL, lot_no * 1000 + 10, lot_no * 1000 + 20 FROM {lots}
UNION ALL SELECT listing_id, 'borrower', lot_no, 'name', 'someone', NULL, lot_no * 1000 + 700, lot_no * 1000 + 720 FROM {lots} WHERE (listing_id + lot_no) % 9 <> 0
UNION ALL SELECT listing_id, 'location', lot_no, 'place', 'somewhere', NULL, CASE WHEN listing_id % 6 = 0 AND lot_no = 2 THEN 1030 ELSE lot_no * 1000 + 30 END, CASE WHEN listing_id % 6 = 0 AND lot_no = 2 THEN 1040 ELSE lot_no * 1000 + 40 END FROM {lots} WHERE (listing_id + lot_no) % 8 <> 0
UNION ALL SELECT listing_id, 'auction_terms', lot_no, 'reserve_price', NULL, CASE WHEN listing_id % 50 = 0 THEN lot_reserve / 10000 ELSE lot_reserve + 10000 END, CASE WHEN listing_id % 41 = 0 THEN 500000 - lot_no * 1000 ELSE lot_no * 1000 + 600 END, CASE WHEN listing_id % 41 = 0 THEN 500010 - lot_no * 1000 ELSE lot_no * 1000 + 610 END FROM {lots} WHERE (listing_id + lot_no) % 10 <> 0
UNION ALL SELECT listing_id, 'auction_terms', lot_no, 'emd', NULL, CASE WHEN listing_id % 7 = 0 THEN lot_reserve * 0.5 ELSE (lot_reserve + 10000) * 0.125 END, lot_no * 1000 + 620, lot_no * 1000 + 630 FROM {lots}
UNION ALL SELECT listing_id, 'extent', lot_no, 'extent', NULL, extent, lot_no * 1000 + 100, lot_no * 1000 + 110 FROM {lots} WHERE listing_id % 17 <> 0
UNION ALL SELECT listing_id, 'extent', lot_no, 'uds', NULL, 10, lot_no * 1000 + 120, lot_no * 1000 + 130 FROM {lots} WHERE lot_no % 2 = 1 AND listing_id % 4 <> 0
UNION ALL SELECT listing_id, 'extent', lot_no, 'uds_parent', NULL, CASE WHEN listing_id % 19 = 0 THEN extent ELSE extent + 1000 END, lot_no * 1000 + 140, lot_no * 1000 + 150 FROM {lots} WHERE lot_no % 2 = 1
UNION ALL SELECT listing_id, 'possession', lot_no, 'possession', CASE WHEN listing_id % 23 = 0 THEN 'vacant' ELSE 'Physical' END, NULL, lot_no * 1000 + 640, lot_no * 1000 + 650 FROM {lots}
UNION ALL SELECT listing_id, 'identifier', lot_no, CASE WHEN listing_id % 29 = 0 THEN 'colour' ELSE 'survey_new' END, CASE WHEN listing_id % 31 = 0 THEN 'null' ELSE '12/3' END, NULL, CASE WHEN listing_id % 3 = 0 AND lot_no = 1 THEN NULL ELSE lot_no * 1000 + 200 END, lot_no * 1000 + 210 FROM {lots}
UNION ALL SELECT listing_id, 'extras', lot_no, 'note', 'note', NULL, lot_no * 1000 + 800, lot_no * 1000 + 810 FROM {lots} WHERE listing_id % 2 = 1
UNION ALL SELECT listing_id, 'boundary', lot_no, 'north', 'road', NULL, lot_no * 1000 + 450, lot_no * 1000 + CASE WHEN listing_id % 14 = 0 THEN 650 ELSE 480 END FROM {lots}
UNION ALL SELECT o_orderkey, 'secured_creditor', 1, 'legal_basis', CASE WHEN o_orderkey % 5 = 0 THEN 'gift' ELSE 'SARFAESI' END, NULL, 5, 8 FROM {orders} WHERE o_orderkey % 13 <> 0
"""
_KINDS = ["survey_old", "survey_new", "patta", "cersai", "property_id", "sale_deed"]


def _notices(spark, sf_dir):
    entities = spark.sql(_ENTITIES, lots=stored(lots(spark, sf_dir), "lots"), orders=table(spark, sf_dir, "orders"))
    return entities, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice"), (F.col("o_orderkey") % 11).cast("int").alias("markers"))


_E = f"WITH {LOTS_SQL}, e AS ({_ENTITIES.format(lots='lots', orders='orders')})"
_DESCRIBED = """
f AS (SELECT DISTINCT notice, lot, start AS a, stop AS b FROM e WHERE cls = 'full_description'),
d AS (SELECT DISTINCT notice, lot, start, stop FROM e WHERE cls IN ('property', 'location', 'extent', 'identifier', 'boundary') AND start IS NOT NULL),
w AS (SELECT d.*, EXISTS (SELECT 1 FROM f WHERE f.notice = d.notice AND f.lot = d.lot AND a <= start AND stop <= b) AS own, EXISTS (SELECT 1 FROM f WHERE f.notice = d.notice AND f.lot <> d.lot AND a <= start AND stop <= b) AS other FROM d),
c AS (SELECT notice, lot, count(CASE WHEN NOT own AND NOT other THEN 1 END) AS short, count(CASE WHEN NOT own AND other THEN 1 END) AS elsewhere, NOT EXISTS (SELECT 1 FROM f WHERE f.notice = w.notice AND f.lot = w.lot) AS bare FROM w GROUP BY notice, lot)
"""


@query(f"{_E}, {_DESCRIBED} SELECT notice, lot, short, elsewhere, bare FROM c WHERE short > 0 OR elsewhere > 0 OR bare")
def description_coverage(spark, sf_dir):
    """Lots whose description misses details, whose details another lot's holds, or without one."""
    return R.described(_notices(spark, sf_dir)[0]).where("short > 0 OR elsewhere > 0 OR bare")


_CHECKS = {
    "missing_secured_creditor": (20, "NOT coalesce(h.creditor, false)"), "missing_borrower": (20, "coalesce(h.borrowers, 0) = 0"), "missing_location": (10, "coalesce(h.locations, 0) = 0"),
    "missing_reserve_price": (20, "coalesce(h.reserves, 0) = 0"), "missing_extent": (20, "NOT coalesce(h.extent, false)"), "missing_property_type": (20, "h.untyped"),
    "possession_type_invalid": (20, "h.vacant"), "missing_uds": (20, "h.flat_without"), "lot_missing_reserve": (20, "h.properties > 1 AND h.reserves < h.properties"),
    "lot_missing_borrower": (20, "h.properties > 1 AND h.borrowers < h.properties"), "lot_missing_location": (20, "h.properties > 1 AND h.locations > 0 AND h.locations < h.properties"),
    "null_value": (4, "h.nulls"), "kind_invalid": (4, "h.odd"), "extras_excess": (4, "h.extras > 5"), "legal_basis_bad": (4, "NOT coalesce(h.legal, false)"),
    "reserve_out_of_range": (10, "h.bad_reserve"), "emd_ratio_off": (4, "h.bad_emd"), "uds_parent_as_own_area": (20, "h.echo"), "lot_under_recall": (10, "o_orderkey % 11 >= 3 AND 2 * coalesce(h.lots, 0) < o_orderkey % 11"),
    "missing_full_description": (30, "k.bare"), "full_description_incomplete": (20, "k.short"), "detail_wrong_lot": (10, "k.elsewhere"), "lot_pairing_off": (10, "x.notice IS NOT NULL"), "ungrounded": (None, "h.loose > 0"),
}
_UNGROUNDED = "CASE WHEN h.loose > 0 THEN CASE WHEN h.loose / h.n < 0.05 THEN 4 WHEN h.loose / h.n < 0.2 THEN 10 ELSE 20 END ELSE 0 END"


@query(
    f"""{_E}, {_DESCRIBED},
l AS (SELECT notice, lot, bool_or(cls = 'property') AS p, max(CASE WHEN cls = 'property' THEN value END) AS t, min(CASE WHEN kind = 'reserve_price' THEN number END) AS r, min(CASE WHEN kind = 'reserve_price' THEN start END) AS ra, min(CASE WHEN kind = 'emd' THEN number END) AS m,
  bool_or(kind = 'uds') AS u, min(CASE WHEN cls = 'full_description' THEN start END) AS da FROM e GROUP BY 1, 2),
echo AS (SELECT DISTINCT x.notice FROM e x JOIN e y ON x.notice = y.notice AND x.lot = y.lot AND x.number = y.number WHERE x.kind = 'uds_parent' AND y.kind = 'extent'),
x AS (SELECT DISTINCT a.notice FROM l a JOIN l b ON a.notice = b.notice AND a.da < b.da AND a.ra > b.ra),
y AS (SELECT notice, count(CASE WHEN p THEN 1 END) AS properties, count(r) AS reserves, bool_or(p AND t IS NULL) AS untyped, bool_or(p AND t = 'Flat' AND NOT u) AS flat_without, bool_or(r < 10000 OR r > 10000000000) AS bad_reserve, bool_or(m / r < 0.04 OR m / r > 0.25) AS bad_emd, count(*) AS lots FROM l GROUP BY 1),
z AS (SELECT notice, count(*) AS n, count(CASE WHEN start IS NULL THEN 1 END) AS loose, bool_or(cls = 'secured_creditor') AS creditor, bool_or(value = 'SARFAESI') AS legal, bool_or(cls = 'extent') AS extent, count(DISTINCT CASE WHEN cls = 'borrower' THEN lot END) AS borrowers, count(DISTINCT CASE WHEN cls = 'location' THEN lot END) AS locations, bool_or(value = 'vacant') AS vacant, bool_or(value = 'null') AS nulls, bool_or(kind = 'colour') AS odd, count(CASE WHEN cls = 'extras' THEN 1 END) AS extras FROM e GROUP BY 1),
h AS (SELECT y.*, z.* EXCLUDE (notice), EXISTS (SELECT 1 FROM echo WHERE echo.notice = y.notice) AS echo FROM y JOIN z USING (notice)),
k AS (SELECT notice, bool_or(bare) AS bare, bool_or(NOT bare AND short + elsewhere > 0 AND short > 0) AS short, bool_or(elsewhere > 0) AS elsewhere FROM c GROUP BY 1)
SELECT o_orderkey AS notice, array_to_string(list_sort(list_filter(["""
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, (_, c) in _CHECKS.items())
    + "], lambda x: x IS NOT NULL)), ',') AS issues, greatest(0, 100 - ("
    + " + ".join(_UNGROUNDED if p is None else f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in _CHECKS.values())
    + ")) AS score FROM orders LEFT JOIN h ON h.notice = o_orderkey LEFT JOIN k ON k.notice = o_orderkey LEFT JOIN x ON x.notice = o_orderkey"
)
def notice_issues(spark, sf_dir):
    """All checks of each notice's reading."""
    entities, notices = _notices(spark, sf_dir)
    return R.notice_issues(R.notice_facts(stored(entities, "entities"), notices, _KINDS))


# A second reading of each lot under the next number: a description 30 characters
# on; a short value moved away, in every fourth notice with other words; and a
# longer one with words added, in every fifth notice too far to meet it.
@query(
    f"WITH {LOTS_SQL}, k AS (SELECT listing_id AS doc, lot_no, unnest([1, 2, 3]) AS c FROM lots) SELECT doc, doc * 100000 + lot_no * 10 + c AS id, CASE WHEN c = 2 AND doc % 4 = 0 OR c = 3 AND doc % 5 = 0 THEN 'orphaned:' || (doc * 100000 + lot_no * 10 + c) ELSE CAST(doc * 100000 + (lot_no + 1) * 10 + c AS VARCHAR) END AS anchor FROM k"
)
def reanchored(spark, sf_dir):
    """Where each entity of a first reading stands in the second."""
    read = stored(lots(spark, sf_dir).select(F.col("listing_id").alias("doc"), "lot_no", "lot_type", F.concat(F.lit("value "), F.col("extent").cast("int")).alias("short")), "read-lots")
    base = read.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("c"))
    cls = F.element_at(F.array(*map(F.lit, ("description", "extent", "borrower"))), F.col("c"))
    at = F.col("lot_no") * 1000 + F.when(F.col("c") == 2, 500).when(F.col("c") == 3, 600).otherwise(0)
    size = F.when(F.col("c") == 2, 10).when(F.col("c") == 3, 100).otherwise(400)
    text = F.when(F.col("c") == 1, F.col("lot_type")).when(F.col("c") == 2, F.col("short")).otherwise(F.lit("borrower of the lot"))
    old = base.select("doc", (F.col("doc") * 100_000 + F.col("lot_no") * 10 + F.col("c")).alias("id"), cls.alias("cls"), F.col("lot_no").alias("lot"), at.alias("start"), (at + size).alias("stop"), text.alias("text"))
    moved = F.when((F.col("c") == 3) & (F.col("doc") % 5 == 0), 60).otherwise(30)
    said = F.when((F.col("c") == 2) & (F.col("doc") % 4 == 0), "zzzzzzzzz").when(F.col("c") == 3, F.concat(text, F.lit(" and all of the guarantors"))).otherwise(text)
    new = base.select("doc", (F.col("doc") * 100_000 + (F.col("lot_no") + 1) * 10 + F.col("c")).alias("id"), cls.alias("cls"), (F.col("lot_no") + 1).alias("lot"), (at + moved).alias("start"), (at + moved + size).alias("stop"), said.alias("text"))
    return R.reanchored(old, new)


_FOUND = "SELECT listing_id AS doc, lot_no + 10 AS lot, lot_reserve AS reserve, CASE WHEN listing_id % 3 = 0 THEN bank_id END AS ident, CASE WHEN lot_no % 4 = 0 THEN 'other' WHEN lot_no % 4 = 1 THEN '' ELSE upper(lot_type) || ' -' END AS lot_type, bank_id + CASE WHEN listing_id % 7 = 0 THEN 1000000 ELSE 0 END AS bank_id FROM {lots} WHERE (listing_id + lot_no) % 5 <> 0"
_FOLD = "regexp_replace(lower(coalesce(CAST({} AS VARCHAR), '')), '[^a-z0-9]+', '', 'g')"


@query(
    f"WITH {LOTS_SQL}, f AS ({_FOUND.format(lots='lots')}), p AS (SELECT l.listing_id % 4 AS stratum, l.lot_type AS gt, l.bank_id AS gb, f.lot_type AS ft, f.bank_id AS fb FROM lots l LEFT JOIN f ON f.doc = l.listing_id AND f.reserve = l.lot_reserve QUALIFY row_number() OVER (PARTITION BY l.listing_id, l.lot_no ORDER BY coalesce(f.ident = l.bank_id, false) DESC, f.lot) = 1), "
    f"v AS (SELECT stratum, 'lot_type' AS field, {_FOLD.format('gt')} AS g, {_FOLD.format('ft')} AS f FROM p UNION ALL SELECT stratum, 'bank_id', {_FOLD.format('gb')}, {_FOLD.format('fb')} FROM p), "
    "c AS (SELECT stratum, field, count(CASE WHEN g <> '' THEN 1 END) AS gold, count(CASE WHEN f <> '' THEN 1 END) AS found, count(CASE WHEN g <> '' AND f <> '' AND (contains(g, f) OR contains(f, g)) THEN 1 END) AS right FROM v GROUP BY 1, 2) SELECT stratum, field, gold, found, right, CASE WHEN found > 0 THEN round(right / found, 4) END AS precision, CASE WHEN gold > 0 THEN round(right / gold, 4) END AS recall FROM c".replace(" right", ' "right"').replace("(right", '("right"')
)
def gold_scores(spark, sf_dir):
    """A reading against gold, by field and stratum."""
    gold = lots(spark, sf_dir).select(F.col("listing_id").alias("doc"), F.col("lot_no").alias("lot"), F.col("lot_reserve").alias("reserve"), F.col("bank_id").alias("ident"), (F.col("listing_id") % 4).alias("stratum"), "lot_type", "bank_id")
    return R.gold_scores(gold, spark.sql(_FOUND, lots=lots(spark, sf_dir)), ["lot_type", "bank_id"], "stratum")


@query(
    "WITH g AS (SELECT l_orderkey, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS n, l_suppkey, l_quantity FROM (SELECT l_orderkey, l_returnflag, l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3)), f AS (SELECT l_orderkey, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS n, l_suppkey + (l_partkey % 3 = 0)::INT AS l_suppkey, l_quantity + (l_partkey % 4 = 0)::INT AS l_quantity FROM g WHERE l_partkey % 5 <> 0) "
    "SELECT l_orderkey, l_returnflag, g.l_partkey AS gold_l_partkey, f.l_partkey AS found_l_partkey, CASE WHEN f.n IS NULL OR g.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN g.l_suppkey = f.l_suppkey THEN 'l_suppkey' END, CASE WHEN g.l_quantity = f.l_quantity THEN 'l_quantity' END) END AS agreed, CASE WHEN f.n IS NULL THEN 'not_found' WHEN g.n IS NULL THEN 'not_gold' ELSE concat_ws(',', CASE WHEN g.l_suppkey <> f.l_suppkey THEN 'l_suppkey' END, CASE WHEN g.l_quantity <> f.l_quantity THEN 'l_quantity' END) END AS questions FROM g FULL JOIN f USING (l_orderkey, l_returnflag, n)"
)
def gold_disagreements(spark, sf_dir):
    """Rows paired within a notice and kind, each once: what agrees, and what to ask."""
    gold = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_partkey").agg(F.max("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    third, fourth = (F.col("l_partkey") % 3 == 0).cast("int"), (F.col("l_partkey") % 4 == 0).cast("int")
    found = gold.where("l_partkey % 5 <> 0").withColumns({"l_suppkey": F.col("l_suppkey") + third, "l_quantity": F.col("l_quantity") + fourth})
    return R.disagreements(gold, found, ["l_orderkey", "l_returnflag"], "l_partkey", ["l_suppkey", "l_quantity"])


@query("WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_discount < 0.07 GROUP BY 1, 2), j AS (SELECT l_orderkey, l_returnflag, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second FROM a FULL JOIN b USING (l_orderkey, l_returnflag)) SELECT *, second - first AS change, CASE sign(second - first) WHEN 1 THEN 'more' WHEN -1 THEN 'fewer' ELSE 'same' END AS verdict FROM j")
def shadow_counts(spark, sf_dir):
    """Two readers' rows for each notice and kind."""
    rows = table(spark, sf_dir, "lineitem")
    return R.shadow_counts(rows.where("l_quantity > 10"), rows.where("l_discount < 0.07"), ["l_orderkey", "l_returnflag"])


# Customers are groups; each that is divisible by 4 is merged with the next one, and that with the one after the next.
@query(
    "WITH g AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN c_custkey - 1 WHEN 3 THEN c_custkey - 3 ELSE c_custkey END AS root, count(o_orderkey) AS n, c_name AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), m AS (SELECT CASE WHEN root IN (SELECT id FROM g) THEN root WHEN id % 4 = 3 AND id - 2 IN (SELECT id FROM g) THEN id - 2 ELSE id END AS id, n, label FROM g) "
    "SELECT id, sum(n)::BIGINT AS n, arg_max(label, (n, length(label), -CAST(regexp_extract(label, '[0-9]+') AS BIGINT))) AS label, count(*) AS members FROM m GROUP BY 1"
)
def merged_groups(spark, sf_dir):
    """Groups after the rulings on proposed merges."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    groups = customers.join(orders, "id", "left").na.fill(0, ["n"])
    known = customers.select("id")
    pairs = known.where("id % 4 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(True).alias("approved")).unionByName(known.where("id % 4 = 3").select(F.col("id").alias("a"), (F.col("id") - 2).alias("b"), F.lit(True).alias("approved"))).unionByName(known.where("id % 4 = 2").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"), F.lit(False).alias("approved")))
    rulings = pairs.join(known.toDF("b"), "b", "left_semi")
    return R.merged_by_rulings(groups, rulings.select("a", "b"), rulings, stored)[0]


@query("SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 WHERE x.c_custkey % 3 <> 0")
def open_proposals(spark, sf_dir):
    """Proposed merges that nobody has ruled on, whichever way round the ruling was written."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    next_ = known.withColumn("b", F.col("a") + 1).join(known.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    ruled = next_.where("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("a") % 2 == 0).alias("approved"))
    groups = known.select(F.col("a").alias("id"), F.lit(1).alias("n"), F.lit("x").alias("label"))
    return R.merged_by_rulings(groups, next_, ruled, stored)[1]


@query(
    f"WITH {LOTS_SQL}, b AS (SELECT listing_id AS doc, lot_no AS lot, round(lot_reserve, -4) AS reserve, bank_id % 5 AS borrower FROM lots), a AS (SELECT listing_id AS doc, listing_id AS listing, round(max(lot_reserve), -4) + CASE WHEN listing_id % 3 = 0 THEN 1 ELSE 0 END AS reserve, min(bank_id % 5) AS borrower FROM lots GROUP BY 1), "
    "c AS (SELECT a.doc, a.listing, (SELECT count(*) FROM b WHERE b.doc = a.doc AND b.reserve = a.reserve) AS np, (SELECT count(*) FROM b WHERE b.doc = a.doc AND b.reserve = a.reserve AND b.borrower = a.borrower) AS nb, (SELECT count(*) FROM b WHERE b.doc = a.doc AND b.borrower = a.borrower) AS nn, (SELECT min(lot) FROM b WHERE b.doc = a.doc AND b.reserve = a.reserve) AS lp, (SELECT min(lot) FROM b WHERE b.doc = a.doc AND b.reserve = a.reserve AND b.borrower = a.borrower) AS lb, (SELECT min(lot) FROM b WHERE b.doc = a.doc AND b.borrower = a.borrower) AS ln FROM a) "
    "SELECT doc, listing, CASE WHEN np = 1 THEN lp WHEN nb = 1 THEN lb WHEN np = 0 AND nn = 1 THEN ln END AS lot, CASE WHEN np = 1 THEN 'reserve' WHEN nb = 1 THEN 'reserve_borrower' WHEN np = 0 AND nn = 1 THEN 'borrower' WHEN np > 1 OR nn > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM c"
)
def lot_of_listing(spark, sf_dir):
    """The lot that a listing sells, by price, then name."""
    b = lots(spark, sf_dir).select(F.col("listing_id").alias("doc"), F.col("lot_no").alias("lot"), F.round("lot_reserve", -4).alias("reserve"), (F.col("bank_id") % 5).alias("borrower"))
    a = b.groupBy("doc").agg(F.max("reserve").alias("reserve"), F.min("borrower").alias("borrower")).withColumns({"listing": F.col("doc"), "reserve": F.col("reserve") + (F.col("doc") % 3 == 0).cast("int")})
    return R.lot_by_price_or_name(a, b)


@query("WITH w AS (SELECT unnest(['license', 'the', 'and', 'copyright', 'zebra']) AS word), p AS (SELECT doc_id, word, nullif(instr(lower(text), word), 0) AS \"at\" FROM documents, w WHERE text IS NOT NULL) SELECT doc_id, word, \"at\", row_number() OVER (PARTITION BY doc_id ORDER BY \"at\" NULLS LAST, word) AS position FROM p")
def in_text_order(spark, sf_dir):
    """Parts in the order in which the text names them."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    parts = d.select("doc_id", F.explode(F.array(*map(F.lit, ("license", "the", "and", "copyright", "zebra")))).alias("word"))
    return R.in_text_order(parts, d, "doc_id", "word")


@query(f"{LISTINGS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY auction_dt, reserve DESC, listing_id) AS slide, count(*) OVER (PARTITION BY city) AS in_group FROM listings WHERE auction_dt >= TIMESTAMP '1996-01-01' AND auction_dt < TIMESTAMP '1996-03-01') SELECT city, listing_id, auction_dt, slide, in_group FROM d WHERE in_group >= 3 AND slide <= 5")
def carousel(spark, sf_dir):
    """The next sales of each city that has several soon."""
    return R.carousel(listings(spark, sf_dir), "city", "auction_dt", "reserve", "listing_id", F.lit("1996-01-01").cast("timestamp_ntz"), 60, 3, 5)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events), t AS (SELECT user_id, list(event_id ORDER BY place) AS ids FROM r WHERE place <= 3 GROUP BY 1) SELECT c_custkey, coalesce(array_to_string(ids, ','), '') AS best FROM customer LEFT JOIN t ON user_id = c_custkey")
def top_replies(spark, sf_dir):
    """Each post's three most liked replies."""
    posts = table(spark, sf_dir, "customer").select("c_custkey")
    replies = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "value")
    found = R.top_replies(posts, replies, "c_custkey", "value", "event_id", 3)
    return found.select("c_custkey", F.array_join(F.transform("replies", lambda r: r["event_id"].cast("string")), ",").alias("best"))


@query(
    "WITH n AS (SELECT c_custkey, list_distinct(list_filter(regexp_split_to_array(lower('Mr ' || c_name || ' ' || c_mktsegment), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS a, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey), m AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name || ' M/S building'), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS b FROM n) "
    "SELECT c_custkey, len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x)))) > 0)) > 0 AS meet FROM m"
)
def names_meet(spark, sf_dir):
    """Whether two names share a word that tells them apart."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    a, b = R.name_words(F.concat(F.lit("Mr "), "c_name", F.lit(" "), "c_mktsegment")), R.name_words(F.concat("n_name", F.lit(" M/S building")))
    return rows.select("c_custkey", R.names_meet(a, b).alias("meet"))


@query("SELECT p_partkey, 'sz:' || p_size || ',' || CASE WHEN p_partkey > 99999 OR p_partkey BETWEEN 1900 AND 2099 THEN '' ELSE p_partkey || ',' END || p_partkey || '/' || p_size || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END AS tokens FROM part WHERE p_partkey <= 99999")
def land_tokens(spark, sf_dir):
    """Measures, survey numbers and what is neither."""
    size = F.col("p_size").cast("string")
    text = F.concat(size, F.lit(" Sq.Ft in S.No. "), "p_partkey", F.lit(" and "), "p_partkey", F.lit("/"), size, F.when(F.col("p_size") % 2 == 0, "a").otherwise(""), F.lit(" dated 2003, phone 9840012345"))
    return table(spark, sf_dir, "part").where("p_partkey <= 99999").select("p_partkey", F.array_join(R.id_words(text), ",").alias("tokens"))


@query(
    "WITH s AS (SELECT o_orderkey, floor(o_totalprice) AS seen FROM orders WHERE o_totalprice >= 2000), a AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN seen WHEN 1 THEN round(seen / pow(10, floor(log10(seen)) - 1)) * pow(10, floor(log10(seen)) - 1) WHEN 2 THEN seen + 1 ELSE seen * 3 + 7 END AS said FROM s), "
    "r AS (SELECT *, (SELECT bool_or(round(round(seen / pow(10, floor(log10(seen)) - k)) * pow(10, floor(log10(seen)) - k), 6) = said) FROM (SELECT unnest([0, 1, 2, 3]) AS k)) AS rounded FROM a) SELECT o_orderkey, CASE WHEN said = seen THEN 'equal' WHEN rounded THEN 'rounded' WHEN abs(seen - said) <= greatest(1, 0.005 * seen) THEN 'near' ELSE 'loose' END AS grounds FROM r"
)
def amount_grounds(spark, sf_dir):
    """How amounts in answers stand to those that the answer could know."""
    seen = F.col("o_totalprice").cast("long").cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(seen)) - 1)
    said = F.when(F.col("o_orderkey") % 4 == 0, seen).when(F.col("o_orderkey") % 4 == 1, F.round(seen / scale) * scale).when(F.col("o_orderkey") % 4 == 2, seen + 1).otherwise(seen * 3 + 7)
    return table(spark, sf_dir, "orders").where("o_totalprice >= 2000").select("o_orderkey", R.amount_grounds(said, F.array(seen)).alias("grounds"))


@query("SELECT o_orderkey, 'Reserve price' AS label, 'Rs ' || CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders UNION ALL SELECT o_orderkey, 'Bank & branch', 'No. ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'Status', o_orderstatus FROM orders")
def page_label_values(spark, sf_dir):
    """Labelled values of pages, from two-cell rows and definition lists."""
    price = F.col("o_totalprice").cast("long").cast("string")
    html = F.concat(F.lit("<html><table><tr><th colspan=2>Notice</th></tr><tr><td>Reserve  price :</td><td><b>Rs</b> "), price, F.lit('</td></tr><TR class="x"><td>Bank &amp; branch</td> <td>No. '), "o_custkey", F.lit("</td></TR><tr><td>one</td><td>two</td><td>three</td></tr></table><dl><dt>Status:</dt><dd>"), "o_orderstatus", F.lit("</dd></dl></html>"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    return rows.select("o_orderkey", F.explode(R.label_values("html")).alias("p")).select("o_orderkey", "p.label", "p.value")
