"""Notices with their layouts, built from the star tables by Spark, and what is read off them again, with SQL that knows the places from how they were built."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, lot_layouts, spans
from ..sources.tables import LOTS_SQL, lots, table

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# A lot's text by the style of its notice, as an expression that Spark and the SQL have in common.
_PRICE, _NAME = "CAST(CAST(floor(lot_reserve) AS BIGINT) AS STRING)", "coalesce(lot_type, 'PLAIN')"
_LOT = f"""CASE style
  WHEN 0 THEN concat({_NAME}, ' flat\\nReserve price: Rs.', {_PRICE}, '/-\\n')
  WHEN 1 THEN concat('<tr><td>', CAST(lot_no AS STRING), '</td><td>', {_NAME}, '</td><td>Rs.', {_PRICE}, '</td></tr><tr><td>EMD</td><td>Rs. 500', '</td></tr>')
  WHEN 2 THEN concat(CAST(lot_no AS STRING), '. Name and details of ', {_NAME}, '\\nprice Rs ', {_PRICE}, '\\n')
  ELSE concat('Lot No. ', CAST(lot_no AS STRING), ' ', {_NAME}, '\\nReserve price: Rs.', {_PRICE}, '\\nPossession: ', repeat('symbolic ', 12), '\\n') END"""
_HEAD = "CASE style WHEN 0 THEN '' WHEN 1 THEN '# Schedule\\n<table><tr><th>Sl No</th><th>Property</th><th>Price</th></tr>' ELSE '# Sale notice\\n' END"
_TAIL = "CASE style WHEN 1 THEN '</table>\\nTerms apply' ELSE 'Terms apply' END"


def _sql(expression: str) -> str:
    return expression.replace("\\n", "' || chr(10) || '").replace("AS STRING", "AS VARCHAR")


def notices(spark, sf_dir):
    """notice_id, style, n (the lots that it should have), text."""
    rows = lots(spark, sf_dir).select("listing_id", "lot_no", "lot_type", "lot_reserve", F.expr("cast(listing_id % 4 as int)").alias("style"))
    each = rows.withColumn("part", F.expr(_LOT))
    whole = each.groupBy("listing_id", "style").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lot_no", "part"))), lambda x: x["part"]), "").alias("body"), F.count("*").cast("int").alias("n"))
    return whole.select(F.col("listing_id").alias("notice_id"), "style", F.expr("CASE WHEN listing_id % 7 = 0 THEN n + 1 ELSE n END").alias("n"), F.concat(F.expr(_HEAD), "body", F.expr(_TAIL)).alias("text"))


_LOTS = f"""{LOTS_SQL}, p AS (
  SELECT listing_id, lot_no, CAST(listing_id % 4 AS INT) AS style, lot_type, lot_reserve FROM lots
), b AS (SELECT *, {_sql(_LOT)} AS part, {_sql(_HEAD)} AS head, {_sql(_TAIL)} AS tail, count(*) OVER (PARTITION BY listing_id) AS n FROM p
), c AS (
  SELECT *, length(head) + sum(length(part)) OVER w - length(part) AS start, length(head) + sum(length(part)) OVER w AS stop, length(head) + sum(length(part)) OVER (PARTITION BY listing_id) + length(tail) AS whole,
    max(CASE WHEN lot_no < n THEN length(part) END) OVER (PARTITION BY listing_id) AS longest
  FROM b WINDOW w AS (PARTITION BY listing_id ORDER BY lot_no)
)"""


@query(
    f"""WITH {_LOTS}, d AS (
  SELECT *, CASE WHEN style = 0 OR (style = 3 AND n = 1) THEN 'price' WHEN style = 1 THEN 'serial' ELSE 'numbered' END AS layout,
    length({_sql("concat('Lot No. ', CAST(lot_no AS STRING), ' ', " + _NAME + ", '\\nReserve price: Rs.', " + _PRICE + ", '\\n')")}) AS upto
  FROM c WHERE listing_id % 7 <> 0
)
SELECT listing_id AS notice_id, layout, CAST(lot_no - 1 AS INT) AS lot_no, CAST(CASE WHEN layout = 'price' AND style = 3 THEN 0 ELSE start END AS INT) AS start,
  CAST(CASE WHEN layout = 'price' THEN CASE WHEN style = 3 THEN length(head) + upto ELSE stop END WHEN lot_no < n THEN stop ELSE least(whole, start + greatest(3000, floor(coalesce(longest, 0) * 1.5))) END AS INT) AS stop,
  CASE WHEN layout <> 'price' THEN CAST(lot_no AS INT) END AS label, CASE WHEN n > 5 THEN CAST((lot_no - 1) // 5 AS INT) END AS chunk
FROM d"""
)
def lot_layouts_found(spark, sf_dir):
    return lot_layouts.find_lots(notices(spark, sf_dir), "notice_id", "text", "n")


# A notice's tables: one with a header of th, a borrower over all rows and prices in lakhs; one whose header is plain and has a cell over two columns; one without money.
_LAKHS = "CAST(CAST(floor(lot_reserve) AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(lot_reserve) AS BIGINT) // 10 % 100 AS VARCHAR), 2, '0')"


def table_notices(spark, sf_dir):
    rows = lots(spark, sf_dir).withColumn("kind", F.expr("cast(listing_id % 3 as int)"))
    price = F.expr("cast(floor(lot_reserve) as bigint)")
    lakhs = F.concat(F.expr("cast(cast(floor(lot_reserve) as bigint) div 1000 as string)"), F.lit("."), F.lpad(F.expr("cast(cast(floor(lot_reserve) as bigint) div 10 % 100 as string)"), 2, "0"))
    sizes = rows.groupBy("listing_id").agg(F.count("*").alias("n"))
    name, number = F.coalesce("lot_type", F.lit("PLAIN")), F.col("lot_no").cast("string")
    first = F.when(F.col("lot_no") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">A &amp; B</td>'))).otherwise("")
    part = (
        F.when(F.col("kind") == 0, F.concat(F.lit("<tr><td>"), number, F.lit("</td>"), first, F.lit("<td>"), name, F.lit("</td><td>"), lakhs, F.lit("</td></tr>\n")))
        .when(F.col("kind") == 1, F.concat(F.lit("<TR><TD>"), number, F.lit("</TD><TD>"), name, F.lit("</TD><TD><b>flat</b> "), F.col("possession"), F.lit("</TD><TD>Rs."), price.cast("string"), F.lit("</TD></TR>")))
        .otherwise(F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>1"), number, F.lit("-02-2024</td></tr>")))
    )
    head = (
        F.when(F.col("kind") == 0, "Sale\n<table><tr><th>Sl. No</th><th>Name of the Borrower</th><th>Property</th><th>Reserve Price (Rs. in Lakhs)</th></tr>\n")
        .when(F.col("kind") == 1, '<table border="1"><tr><td>Lot No</td><td colspan="2">Description</td><td>Upset price</td></tr>')
        .otherwise("<table>")
    )
    body = rows.join(sizes, "listing_id").withColumn("part", part).groupBy("listing_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lot_no", "part"))), lambda x: x["part"]), "").alias("body"))
    return body.select(F.col("listing_id").alias("notice_id"), F.concat(head, "body", F.lit("</table> end")).alias("text"))


_PRICE_SQL, _NAME_SQL, _NO = "CAST(CAST(floor(lot_reserve) AS BIGINT) AS VARCHAR)", "coalesce(lot_type, 'PLAIN')", "CAST(lot_no AS VARCHAR)"
_FIRST = "CASE WHEN lot_no = 1 THEN '<td rowspan=\"' || n || '\">A &amp; B</td>' ELSE '' END"


@query(
    f"""WITH {LOTS_SQL}, a AS (SELECT *, listing_id % 3 AS kind, count(*) OVER (PARTITION BY listing_id) AS n FROM lots
), b AS (SELECT *, CASE kind WHEN 0 THEN '<tr><td>' || {_NO} || '</td>' || {_FIRST} || '<td>' || {_NAME_SQL} || '</td><td>' || {_LAKHS} || '</td></tr>' || chr(10)
    WHEN 1 THEN '<TR><TD>' || {_NO} || '</TD><TD>' || {_NAME_SQL} || '</TD><TD><b>flat</b> ' || possession || '</TD><TD>Rs.' || {_PRICE_SQL} || '</TD></TR>'
    ELSE '<tr><td>' || {_NAME_SQL} || '</td><td>1' || {_NO} || '-02-2024</td></tr>' END AS part,
    CASE kind WHEN 0 THEN 'Sale' || chr(10) || '<table><tr><th>Sl. No</th><th>Name of the Borrower</th><th>Property</th><th>Reserve Price (Rs. in Lakhs)</th></tr>' || chr(10) WHEN 1 THEN '<table border="1"><tr><td>Lot No</td><td colspan="2">Description</td><td>Upset price</td></tr>' ELSE '<table>' END AS head FROM a
), s AS (SELECT *, length(head) + sum(length(part)) OVER (PARTITION BY listing_id ORDER BY lot_no) - length(part) AS place FROM b
), c AS (
  SELECT listing_id, kind, lot_no - 1 AS r, 0 AS col, CASE kind WHEN 2 THEN NULL ELSE 'serial' END AS role, CASE kind WHEN 2 THEN {_NAME_SQL} ELSE {_NO} END AS value, place + 8 AS start, NULL AS amount FROM s
  UNION ALL SELECT listing_id, kind, lot_no - 1, 1, CASE kind WHEN 0 THEN 'borrower' WHEN 1 THEN 'description' ELSE CASE WHEN 2 * least(n, 9) > n THEN 'date' WHEN 2 * (n - 999) > n THEN 'amount' END END, CASE kind WHEN 0 THEN 'A &amp; B' WHEN 1 THEN {_NAME_SQL} ELSE '1' || {_NO} || '-02-2024' END,
    CASE kind WHEN 0 THEN length(head) + length('<tr><td>1</td><td rowspan="">') + length(n::VARCHAR) WHEN 1 THEN place + length('<TR><TD></TD><TD>') + length({_NO}) ELSE place + length('<tr><td></td><td>') + length({_NAME_SQL}) END, CASE WHEN kind = 2 AND 2 * (n - 999) > n AND lot_no >= 1000 THEN CAST('1' || {_NO} AS DOUBLE) END FROM s
  UNION ALL SELECT listing_id, kind, lot_no - 1, 2, 'description', CASE kind WHEN 0 THEN {_NAME_SQL} ELSE 'flat ' || possession END,
    CASE kind WHEN 0 THEN place + length('<tr><td></td><td>') + length({_NO}) + length({_FIRST}) ELSE place + length('<TR><TD></TD><TD></TD><TD>') + length({_NO}) + length({_NAME_SQL}) END, NULL FROM s WHERE kind < 2
  UNION ALL SELECT listing_id, kind, lot_no - 1, 3, 'reserve_price', CASE kind WHEN 0 THEN {_LAKHS} ELSE 'Rs.' || {_PRICE_SQL} END,
    place + length(part) - length(CASE kind WHEN 0 THEN {_LAKHS} || '</td></tr>' || chr(10) ELSE 'Rs.' || {_PRICE_SQL} || '</TD></TR>' END),
    CASE kind WHEN 0 THEN CAST({_LAKHS} AS DECIMAL(20, 4)) * 100000 ELSE CAST({_PRICE_SQL} AS DECIMAL(20, 4)) END::DOUBLE FROM s WHERE kind < 2
)
SELECT listing_id AS notice_id, CAST(r AS INT) AS row_no, col, role, CASE WHEN role IS NOT NULL THEN CASE WHEN kind = 2 THEN 'cells' ELSE 'header' END END AS role_from, CASE WHEN kind = 0 AND col = 3 THEN 'lakh' END AS unit, amount, kind < 2 AS lot_row, CAST(start AS INT) AS start, value FROM c"""
)
def notice_table_grid(spark, sf_dir):
    """Data slots of tables with spans, two kinds of header, and none.

    Days of lots from the tenth on have three digits and are no dates, so that a
    table without header has dates while most of its lots are before that.
    """
    return grids.table_grid(table_notices(spark, sf_dir), "notice_id", "text").where("row_no >= 0").select("notice_id", "row_no", "col", "role", "role_from", "unit", "amount", "lot_row", "start", "value")


@query(
    f"""WITH d AS (SELECT doc_id, text, regexp_replace(substr(text, CAST(length(text) // 3 + 1 AS INT), 120), '^\\s+|\\s+$', '', 'g') AS e FROM documents WHERE length(text) >= 240 AND NOT contains(text, '¤')),
x AS (SELECT doc_id, text, e, lower(text) AS t, lower(e) AS l FROM d WHERE length(e) >= 100)
SELECT doc_id, 100.0 AS likeness, CAST(instr(t, l) - 1 AS INT) AS start, CAST(instr(t, l) - 1 + length(l) AS INT) AS stop FROM x WHERE length(t) = length(text) AND instr(t, l) > 0"""
)
def excerpt_spans(spark, sf_dir):
    """An excerpt of each long text, found where it stands first."""
    rows = _excerpts(spark, sf_dir)
    return spans.located(rows, "e", "text", 90.0).select("doc_id", "likeness", "start", "stop")


def _excerpts(spark, sf_dir):
    long = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace(F.expr("substr(text, cast(length(text) div 3 + 1 as int), 120)"), r"^\s+|\s+$", "").alias("e")).where("length(text) >= 240 AND NOT contains(text, '¤')")
    return long.where("length(e) >= 100 AND length(lower(text)) = length(text) AND instr(lower(text), lower(e)) > 0")


@query(None)
def located_passages(spark, sf_dir):
    """Benchmark passages in documents, also edited ones: held against alignments of whole texts in the tests."""
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = spans.seeded_pairs(items, "item_id", "passage", docs, "doc_id", "text")
    rows = pairs.join(items, "item_id").join(docs, "doc_id")
    return spans.located(rows, "passage", "text").where("likeness IS NOT NULL").select("item_id", "doc_id", "likeness", "start", "stop", "mark_start", "mark_stop")
