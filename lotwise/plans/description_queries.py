"""Small readers of descriptions, and safety of links, on texts and links that Spark builds from the star tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import descriptions as D
from ..operators import link_safety as L
from ..sources.scratch import scratch_path, stored
from ..sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) >= 2))"


@query(f"SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 4) AS overlap FROM (SELECT p_partkey, {_W.format('p_name')} AS a, {_W.format("p_type || ' ' || p_name || ' x'")} AS b FROM part)")
def description_overlaps(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.overlap(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", F.lit("x"))).alias("overlap"))


@query("SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_filter([n * 4356, n * 1000, (n * 107639 + 500) // 1000], lambda x: x > 0))), lambda x: x), ',') AS tenths FROM (SELECT p_partkey, p_partkey::BIGINT AS n FROM part)")
def described_areas(spark, sf_dir):
    """All areas of a description, in tenths of a square foot."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(n, F.lit(" Cents or "), n, F.lit("00 Sq. Ft of land ("), n, F.lit("00 square feet), about "), n, F.lit(" sq.m; 5 rooms"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(D.areas(text), lambda x: F.round(x * 10).cast("long")), ",").alias("tenths"))


@query(
    "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE lower(replace(n_name, '_', '_')) || CASE n_nationkey % 4 WHEN 2 THEN ' and sons' ELSE '' END END AS place, n_nationkey % 4 IN (0, 3) AS taluk FROM nation"
)
def place_names(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    said = F.when(k == 0, F.concat("n_name", F.lit(" Village,  Taluk."))).when(k == 1, F.concat(F.lit(" "), "n_name", F.lit(" Dist."))).when(k == 2, F.concat("n_name", F.lit("&Sons P.O"), F.lit(""))).otherwise("Taluk")
    said = F.when(k == 2, F.concat("n_name", F.lit(" & Sons, Vill"))).otherwise(said)
    return table(spark, sf_dir, "nation").select("n_nationkey", D.place_name(said).alias("place"), D.says_taluk(said).alias("taluk"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN n * 100000 WHEN 1 THEN n * 10000000 WHEN 2 THEN 2889000 WHEN 3 THEN 3515000 WHEN 6 THEN 7500000 + n END AS rupees, CASE o_orderkey % 7 WHEN 4 THEN 'illegible' WHEN 5 THEN 'none' ELSE 'ok' END AS state, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'symbolic' WHEN 1 THEN 'physical' END AS possession, 'land at site ' || o_orderkey AS description FROM (SELECT o_orderkey, 1 + o_orderkey % 90 AS n FROM orders)"
)
def reader_values(spark, sf_dir):
    """Money, possession and text as a reader of notices takes them, with figures that recognition broke."""
    n, key = (1 + F.col("o_orderkey") % 90), F.col("o_orderkey")
    quotes = [F.concat(F.lit("Rs."), n.cast("string"), F.lit(".00 Lakhs")), F.concat(n.cast("string"), F.lit(" Cr")), F.lit("Rs. 2889000/- (Rupees Twenty Eight Lakhs)"), F.lit("Rs 35.15,000"), F.lit("12.50.000"), F.lit("as per deed"), F.concat(F.lit("Rs "), (7_500_000 + n).cast("string"), F.lit(" lakh"))]
    kinds = [F.lit("Symbolic Possession"), F.lit("under PHYSICAL possession"), F.lit("symbolic / physical / constructive"), F.lit("possession")]
    pick = lambda some: F.element_at(F.array(*some), (key % len(some) + 1).cast("int"))
    rupees, state = D.read_money(pick(quotes))
    text = F.concat(F.lit("land at site "), key.cast("string"), F.when(key % 2 == 0, F.lit(" , Province/State Tamil Nadu City/Town X")).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", rupees.alias("rupees"), state.alias("state"), D.possession(pick(kinds)).alias("possession"), D.without_glued_fields(text).alias("description"))


# Orders of a customer in a year: the first two are linked for certain, the first and third in review, and every tenth
# customer's first two in review too. Sources go by the priority's first digit.
_LINKS = """o AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS source, o_totalprice AS price, o_orderstatus AS unit, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS i, year(o_orderdate) AS y FROM orders),
l AS (SELECT a.id AS a, b.id AS b, 'CONFIRMED' AS confidence FROM o a JOIN o b ON a.c = b.c AND a.y = b.y AND a.i = 1 AND b.i = 2
  UNION ALL SELECT a.id, b.id, 'PENDING' FROM o a JOIN o b ON a.c = b.c AND a.y = b.y AND a.i = 1 AND (b.i = 3 OR b.i = 2 AND a.c % 10 = 0)
  UNION ALL SELECT a.id, b.id, 'CONFIRMED' FROM o a JOIN o b ON a.c = b.c AND a.y = b.y AND a.i = 2 AND b.i = 3 AND a.c % 3 = 0)"""


def _links(spark, sf_dir):
    from pyspark.sql.window import Window

    by = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("source"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("unit"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.row_number().over(by).alias("i"))
    at = lambda i, name: rows.where(F.col("i") == i).select("c", "y", F.col("id").alias(name))
    link = lambda i, j, how: at(i, "a").join(at(j, "b"), ["c", "y"]).withColumn("confidence", F.lit(how))
    both = link(1, 2, "CONFIRMED").unionByName(link(1, 3, "PENDING")).unionByName(link(1, 2, "PENDING").where("c % 10 = 0")).unionByName(link(2, 3, "CONFIRMED").where("c % 3 = 0"))
    return rows.select("id", "source", "price", "unit"), stored(both.select("a", "b", "confidence"), "links")


@query(
    f"""WITH RECURSIVE {_LINKS}, e AS (SELECT a AS x, b AS y FROM l WHERE confidence = 'CONFIRMED' UNION SELECT b, a FROM l WHERE confidence = 'CONFIRMED'), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS id, least(x, min(y)) AS k FROM r GROUP BY x), g AS (SELECT k, source, min(id) AS a, max(id) AS b, count(DISTINCT round(price)) AS prices, count(DISTINCT unit) AS units, count(*) AS n FROM m JOIN o USING (id) GROUP BY 1, 2 HAVING count(*) > 1),
d AS (SELECT DISTINCT a, b FROM l WHERE confidence = 'PENDING'), w AS (SELECT d.a, d.b, EXISTS (SELECT 1 FROM l WHERE l.a = d.a AND l.b = d.b AND confidence = 'CONFIRMED') AS twice FROM d)
SELECT CASE WHEN prices > 1 THEN 'prices_differ' ELSE 'units_differ' END AS problem, a, b FROM g WHERE prices > 1 OR units > 1
UNION ALL SELECT CASE WHEN twice THEN 'confirmed_and_pending' ELSE 'already_merged' END, a, b FROM w WHERE twice OR (SELECT k FROM m WHERE id = a) = (SELECT k FROM m WHERE id = b)"""
)
def link_problems(spark, sf_dir):
    rows, links = _links(spark, sf_dir)
    return L.problems(links, rows, partial(stored, name="link-safety"))


@query(
    f"""WITH {_LINKS}, c AS (SELECT DISTINCT l.a, o.source FROM l JOIN o ON o.id = l.b WHERE confidence = 'CONFIRMED')
SELECT a, source FROM c WHERE a % 5 <> 0 ORDER BY sha256('2026-11-28|' || a || '|' || source), a, source LIMIT 20"""
)
def spot_checks(spark, sf_dir):
    """Twenty confirmed cases to look at on one day; every fifth has been decided."""
    rows, links = _links(spark, sf_dir)
    cases = links.join(rows.select(F.col("id").alias("b"), "source"), "b").select("a", "source", "confidence")
    return L.spot_sample(cases, cases.where("a % 5 = 0").select("a", "source"), "2026-11-28", 20)


@query(
    f"""WITH {_LINKS}, s AS (SELECT a AS id, b AS other FROM l WHERE confidence = 'CONFIRMED' UNION SELECT b, a FROM l WHERE confidence = 'CONFIRMED'),
n AS (SELECT s.id, array_to_string(list_sort(list(DISTINCT o.source)), ',') AS also_on, string_agg(s.other || ':price', ',' ORDER BY s.other) AS other_listings FROM s JOIN o ON o.id = s.other GROUP BY 1),
p AS (SELECT l_orderkey AS id, string_agg(CASE WHEN l_linenumber % 3 = 1 THEN 'p' ELSE 'u' END || l_linenumber, ' ' ORDER BY l_linenumber <> 2, l_linenumber) AS photos FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 4 GROUP BY 1)
SELECT o.id, o.source, coalesce(also_on, '') AS also_on, coalesce(other_listings, '') AS other_listings, coalesce(photos, '') AS photos FROM o LEFT JOIN n USING (id) LEFT JOIN p USING (id)"""
)
def canonical_columns(spark, sf_dir):
    """Other portals, copies and photos of each listing; the second photo is the main one, the fourth has no address."""
    rows, links = _links(spark, sf_dir)
    n = F.col("l_linenumber")
    shown = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    photos = shown.select(F.col("l_orderkey").alias("id"), n.alias("position"), F.when(n != 4, F.concat(F.lit("u"), n.cast("string"))).alias("url"), F.when(n.isin(1, 7), F.concat(F.lit("p"), n.cast("string"))).alias("public_url"), (n == 2).alias("is_main"))
    return L.canonical_columns(rows.select("id", "source"), links.withColumn("method", F.lit("price")), photos)


@query("SELECT r_regionkey::VARCHAR AS code, r_name AS name FROM region")
def spreadsheet_rows(spark, sf_dir):
    """Rows of an XML spreadsheet, written and read again by Spark, a row at a time."""
    out = scratch_path(spark, "spreadsheet")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name")).write.option("rowTag", "Row").option("rootTag", "Table").format("xml").save(out)
    return spark.read.schema("code string, name string").option("rowTag", "Row").format("xml").load(out)
