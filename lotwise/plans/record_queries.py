"""Search orchestration, matching, merging, review and normaliser queries over the star tables, and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import areas as Ar
from ..functions import normalize as N
from ..operators import analytics as A
from ..operators import matching as M
from ..operators import search as S
from ..sources.scratch import scratch_path, stored
from ..sources.tables import LISTINGS_SQL, LOTS_SQL, listings, lots, table

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _rich(spark, sf_dir):
    """Listings with the nearest deadline and largest area of their lots, and an earnest deposit."""
    of = lots(spark, sf_dir).groupBy("listing_id").agg(F.min("deadline").alias("deadline"), F.max("extent").alias("area"))
    return listings(spark, sf_dir).join(of, "listing_id", "left").withColumn("emd", F.col("reserve") / 10)


_RICH = f"{LISTINGS_SQL}, {LOTS_SQL}, rich AS (SELECT l.*, t.deadline, t.area, l.reserve / 10 AS emd FROM listings l LEFT JOIN (SELECT listing_id, min(deadline) AS deadline, max(extent) AS area FROM lots GROUP BY 1) t USING (listing_id))"


# search ----------------------------------------------------------------------

_ORDERS = {
    "deadline": "deadline", "auction_date": "auction_dt", "price_asc": "reserve", "price_desc": "reserve DESC", "area_desc": "area DESC", "recent": "auction_dt DESC",
    "deadline_asc": "deadline", "deadline_desc": "deadline DESC", "start_asc": "auction_dt", "start_desc": "auction_dt DESC", "emd_asc": "emd", "emd_desc": "emd DESC",
}
SIX_SORTS = ["deadline", "auction_date", "price_asc", "price_desc", "area_desc", "recent"]
EIGHT_SORTS = ["deadline_asc", "deadline_desc", "start_asc", "start_desc", "price_asc", "price_desc", "emd_asc", "emd_desc"]


def _pages_sql(sorts: list[str]) -> str:
    return _RICH + " " + " UNION ALL ".join(f"SELECT '{s}' AS sort, position, listing_id FROM (SELECT listing_id, row_number() OVER (ORDER BY {_ORDERS[s]} NULLS LAST, listing_id) AS position FROM rich) WHERE position <= 10" for s in sorts)


@query(_pages_sql(SIX_SORTS))
def six_sorts(spark, sf_dir):
    return S.pages(_rich(spark, sf_dir), SIX_SORTS, 10)


@query(_pages_sql(EIGHT_SORTS))
def eight_sorts(spark, sf_dir):
    return S.pages(_rich(spark, sf_dir), EIGHT_SORTS, 10)


@query(f"{LISTINGS_SQL} SELECT listing_id, reserve, (SELECT count(*) FROM listings WHERE state = 'ASIA') AS total FROM listings WHERE state = 'ASIA' ORDER BY reserve DESC NULLS LAST, listing_id LIMIT 15")
def panel_rows(spark, sf_dir):
    """A panel's first rows beside the exact number of all."""
    rows = listings(spark, sf_dir).where("state = 'ASIA'").select("listing_id", "reserve")
    return S.capped(rows, S.sort_columns("price_desc"), 15)


@query(f"{LISTINGS_SQL} SELECT listing_id FROM listings WHERE contains(lower(coalesce(city, '')), '_1') OR contains(lower(coalesce(city, '')), 'build') OR contains(lower(coalesce(category, '')), '_1') OR contains(lower(coalesce(category, '')), 'build')")
def any_contains(spark, sf_dir):
    return listings(spark, sf_dir).where(S.any_contains(["city", "category"], ["_1", "BUILD"])).select("listing_id")


@query("SELECT c_custkey FROM customer WHERE regexp_full_match(lower(c_name), 'customer#0*[1-9]7')")
def anchored_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(S.whole_match("c_name", "customer#0*[1-9]7")).select("c_custkey")


@query(f"{LISTINGS_SQL} SELECT listing_id FROM listings WHERE category IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE')")
def type_synonyms(spark, sf_dir):
    """Wider types stand for several; others for themselves."""
    return listings(spark, sf_dir).where(S.typed("category", ["building", "FURNITURE"])).select("listing_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 23:59:59' AND o_orderdate >= TIMESTAMP '1996-06-01 00:00:00'")
def date_promotion(spark, sf_dir):
    """A day as the upper end of a range counts whole."""
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= day("1996-06-01 00:00:00")) & (F.col("o_orderdate") <= S.end_of_day(day("1996-06-30 00:00:00")))).select("o_orderkey")


_ASKED = {"state": "asia", "types": ["building", "vehicle"], "status": ["O", "F"], "text": "nation", "price_least": 20_000, "price_most": 400_000, "area_least": 5, "area_most": 50, "from_day": "1993-01-01", "to_day": "1998-06-30", "sources": [1, 2, 3, 4], "priced": True, "dated": True}
_ASKED_SQL = (
    "lower(state) = 'asia' AND category IN ('BUILDING', 'HOUSEHOLD', 'AUTOMOBILE', 'MACHINERY') AND status IN ('O', 'F') AND (contains(lower(city), 'nation') OR contains(lower(state), 'nation') OR contains(lower(category), 'nation') OR contains(lower(borrower), 'nation')) "
    "AND reserve BETWEEN 20000 AND 400000 AND area BETWEEN 5 AND 50 AND auction_dt BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-06-30 23:59:59' AND source_rank IN (1, 2, 3, 4)"
)


@query(f"{_RICH} SELECT listing_id, city, reserve FROM rich WHERE {_ASKED_SQL}")
def seventeen_filters(spark, sf_dir):
    """The filter builder with most of its filters set."""
    return S.auction_filters(**_ASKED).on(_rich(spark, sf_dir)).select("listing_id", "city", "reserve")


_DIMENSIONS = {
    "city": "city", "state": "state", "category": "category", "status": "status", "source_rank": "CAST(source_rank AS VARCHAR)", "month": "strftime(auction_dt, '%Y-%m')",
    "borrower": "borrower", "price_band": "CASE WHEN reserve < 100000 THEN 'low' WHEN reserve < 200000 THEN 'middle' WHEN reserve IS NOT NULL THEN 'high' END", "area_band": "CASE WHEN area < 25 THEN 'small' WHEN area IS NOT NULL THEN 'large' END", "deadline_year": "strftime(deadline, '%Y')",
}


def _dimension_columns():
    band = F.when(F.col("reserve") < 100_000, "low").when(F.col("reserve") < 200_000, "middle").when(F.col("reserve").isNotNull(), "high")
    size = F.when(F.col("area") < 25, "small").when(F.col("area").isNotNull(), "large")
    return {c: F.col(c) for c in ("city", "state", "category", "status", "source_rank", "borrower")} | {"month": S.month("auction_dt"), "price_band": band, "area_band": size, "deadline_year": F.date_format("deadline", "yyyy")}


@query(
    f"{_RICH}, v AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS value FROM rich" for n, e in _DIMENSIONS.items())
    + "), c AS (SELECT dimension, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2) SELECT dimension, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 40"
)
def distributions(spark, sf_dir):
    """Ten dimensions' values in one pass, at most 40 each."""
    return S.top_values(_rich(spark, sf_dir), _dimension_columns(), 40)




def _found(spark, sf_dir, filters, group=None):
    rows = _rich(spark, sf_dir)
    return S.found(rows, filters, {"city": F.col("city"), "status": F.col("status")}, 10, group)


_HIT = f"{_RICH}, hit AS (SELECT * FROM rich WHERE lower(state) = 'europe' AND reserve >= 50000)"
_STATS = "SELECT 'stats' AS section, 1 AS position, 'total' AS label, count(*) AS n FROM hit UNION ALL SELECT 'stats', 2, 'priced', count(reserve) FROM hit"


@query(
    f"{_HIT}, v AS (SELECT 'city' AS d, city AS value FROM hit UNION ALL SELECT 'status', status FROM hit), c AS (SELECT d, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, value) AS r FROM c) {_STATS} "
    "UNION ALL SELECT 'row', row_number() OVER (ORDER BY reserve DESC NULLS LAST, listing_id), CAST(listing_id AS VARCHAR), NULL FROM (SELECT * FROM hit ORDER BY reserve DESC NULLS LAST, listing_id LIMIT 10) "
    "UNION ALL SELECT 'refine', row_number() OVER (ORDER BY d, n DESC, value), d || ':' || value, n FROM k WHERE r <= 3"
)
def find_rows(spark, sf_dir):
    """A search with rows: counts, the first rows and ways to narrow."""
    return _found(spark, sf_dir, S.auction_filters(state="europe", price_least=50_000))


@query(f"{_HIT} {_STATS} UNION ALL SELECT 'group', row_number() OVER (ORDER BY n DESC, value), value, n FROM (SELECT category AS value, count(*) AS n FROM hit WHERE category IS NOT NULL GROUP BY 1)")
def find_groups(spark, sf_dir):
    """The same search, grouped: no rows."""
    return _found(spark, sf_dir, S.auction_filters(state="europe", price_least=50_000), F.col("category"))


@query(
    f"{_RICH}, r AS (SELECT count(CASE WHEN reserve >= 1000000000 THEN 1 END) AS state, count(CASE WHEN lower(state) = 'europe' THEN 1 END) AS price_least FROM rich), x AS (SELECT 'state' AS label, state AS n FROM r UNION ALL SELECT 'price_least', price_least FROM r), y AS (SELECT * FROM x WHERE n > 0) "
    "SELECT 'stats' AS section, 1 AS position, 'total' AS label, 0 AS n UNION ALL SELECT 'stats', 2, 'priced', 0 UNION ALL SELECT 'relax', row_number() OVER (ORDER BY n DESC, label), label, n FROM y "
    "UNION ALL SELECT 'hint', 1, coalesce((SELECT 'none matches all 2 filters; without ' || label || ' there are ' || n FROM y ORDER BY n DESC, label DESC LIMIT 1), 'nothing matches'), NULL"
)
def find_nothing(spark, sf_dir):
    """A search without rows: which filter to drop, and a hint."""
    return _found(spark, sf_dir, S.auction_filters(state="europe", price_least=1_000_000_000))


@query(f"{LISTINGS_SQL}, d AS (SELECT listing_id, coalesce(CASE WHEN source_rank = 1 THEN city END, CASE WHEN status = 'O' THEN state END, city) AS district FROM listings) SELECT district, count(*) AS n FROM d GROUP BY 1")
def district_effective(spark, sf_dir):
    """The notice's district, else the portal's, else the city."""
    rows = listings(spark, sf_dir).select(F.coalesce(F.when(F.col("source_rank") == 1, F.col("city")), F.when(F.col("status") == "O", F.col("state")), F.col("city")).alias("district"))
    return rows.groupBy("district").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, value IN ('O', 'F') AS allowed FROM c")
def enum_validation(spark, sf_dir):
    """Which values of a field are among the allowed ones, and how many rows have them."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")).withColumn("allowed", F.col("value").isin("O", "F"))


@query(f"{LISTINGS_SQL}, {LOTS_SQL}, a AS (SELECT unnest([3, 1, 7, 999999999, 32]) AS listing_id, unnest([0, 1, 2, 3, 4]) AS position) SELECT a.position, a.listing_id, city, reserve, l.listing_id IS NOT NULL AS found, coalesce((SELECT string_agg(lot_no || ':' || CAST(extent AS INT), ',' ORDER BY lot_no) FROM lots t WHERE t.listing_id = a.listing_id), '') AS lots FROM a LEFT JOIN listings l USING (listing_id)")
def listing_details(spark, sf_dir):
    """Up to ten listings in the caller's order, with their lots as one list; ids that don't exist stay, not found."""
    asked = S.lookup(listings(spark, sf_dir).select("listing_id", "city", "reserve"), [3, 1, 7, 999_999_999, 32], "listing_id")
    own = lots(spark, sf_dir).join(F.broadcast(asked.select("listing_id")), "listing_id", "left_semi").groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("lot_no", F.col("extent").cast("int").alias("extent")))).alias("own"))
    text = F.array_join(F.transform("own", lambda x: F.concat_ws(":", x["lot_no"], x["extent"])), ",")
    return asked.join(own, "listing_id", "left").select("position", "listing_id", "city", "reserve", "found", F.coalesce(text, F.lit("")).alias("lots"))


_ANGLES = ["state = 'ASIA'", "category = 'BUILDING'", "reserve > 200000"]


@query(f"{LISTINGS_SQL} SELECT listing_id, CASE WHEN {_ANGLES[0]} THEN 'place' WHEN {_ANGLES[1]} THEN 'type' ELSE 'price' END AS angle, coalesce(CAST({_ANGLES[0]} AS INT), 0) + coalesce(CAST({_ANGLES[1]} AS INT), 0) + coalesce(CAST({_ANGLES[2]} AS INT), 0) AS angles FROM listings WHERE {' OR '.join(_ANGLES)}")
def first_angle(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return M.first_angle([(n, rows.where(a)) for n, a in zip(("place", "type", "price"), _ANGLES, strict=True)], "listing_id")


# normalisers -----------------------------------------------------------------


@query("SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def dates_read(spark, sf_dir):
    """Times of events, written in four shapes and read back."""
    ts = F.col("ts")
    text = F.element_at(F.array(F.date_format(ts, "dd-MM-yyyy hhmm a"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format(ts, "d MMM yyyy"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(N.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


_WRITTEN = [("Cents", "cent", 435.6), ("sq. ft", "sq_ft", 1.0), ("squareft", None, None), ("Acres and more", "acre", 43560.0), ("Sq.Mtrs.", "sq_m", 10.763910), ("percent", None, None), ("hectare", "hectare", 107639.104)]


@query(
    "SELECT value, unit, CASE WHEN unit IS NOT NULL THEN round(value * factor, 2) END AS sqft, count(*) AS n FROM (SELECT CAST(l_quantity AS DOUBLE) + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0 END AS value, "
    + " ".join(["CASE l_linenumber % 7"] + [f"WHEN {i} THEN '{u}'" for i, (_, u, _) in enumerate(_WRITTEN) if u] + ["END AS unit, CASE l_linenumber % 7"] + [f"WHEN {i} THEN {f}" for i, (_, u, f) in enumerate(_WRITTEN) if u] + ["END AS factor"])
    + " FROM lineitem) GROUP BY ALL"
)
def areas_read(spark, sf_dir):
    """Quantities written with fractions and units, and read back."""
    spelling = F.element_at(F.array(*[F.lit(w) for w, _, _ in _WRITTEN]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " 1/2 ").otherwise(" "), spelling)
    return table(spark, sf_dir, "lineitem").select(Ar.area(text).alias("a")).select("a.*").groupBy("value", "unit", "sqft").agg(F.count("*").alias("n"))


@query("SELECT how, sqft, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'stated' WHEN 1 THEN 'multi_value' WHEN 2 THEN 'composite' WHEN 3 THEN 'converted' ELSE 'unparsed' END AS how, CASE p_partkey % 5 WHEN 0 THEN p_size * 100.0 WHEN 3 THEN round(p_size * 435.6, 2) END AS sqft FROM part) GROUP BY ALL")
def stated_areas(spark, sf_dir):
    """Which figure in square feet a text states, and how."""
    n = F.col("p_size").cast("int").cast("string")
    texts = [F.concat(n, F.lit(" cents ("), n, F.lit("00 Sq. ft)")), F.concat(n, F.lit("00 sq.ft (each plot "), n, F.lit(" sq.ft)")), F.concat(n, F.lit(" cents and 7 sq.ft")), F.concat(n, F.lit(" Cents")), F.lit("land as in the deed")]
    # equal texts are read once
    each = table(spark, sf_dir, "part").select(F.element_at(F.array(*texts), (F.col("p_partkey") % 5 + 1).cast("int")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return each.select(Ar.stated_sqft(F.col("text")).alias("a"), "n").groupBy("a.how", "a.sqft").agg(F.sum("n").alias("n"))


@query("SELECT verdict, severity, count(*) AS n FROM (SELECT CASE WHEN f IS NULL THEN 'unknown' WHEN f = 1.005 THEN 'agree' WHEN f = 10 THEN 'magnitude_slip' ELSE 'disagree' END AS verdict, CASE WHEN f = 10 THEN 'critical' WHEN f = 2 THEN 'med' END AS severity FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 1.005 WHEN 1 THEN 10 WHEN 2 THEN 2 END AS f FROM lineitem)) GROUP BY ALL")
def area_agreement(spark, sf_dir):
    """Areas of listing and notice compared; what disagrees has a severity."""
    own = F.col("l_quantity").cast("double")
    other = F.element_at(F.array(own * 1.005, own * 10, own * 2, F.lit(None).cast("double")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(Ar.compared_areas(own, other).alias("verdict"))
    return rows.groupBy("verdict", F.when(F.col("verdict") == "magnitude_slip", "critical").when(F.col("verdict") == "disagree", "med").alias("severity")).agg(F.count("*").alias("n"))


_LABELS = [
    ("Sale Proclamation", "proclamation"), ("Terms and Conditions of E auction", "terms"), ("3453_Property-Details.pdf", "property_details"), ("Declaration.pdf", "affidavit"), ("BS-City-Bank", "publication"),
    ("bank-paper-city-12-09-2026.pdf", "publication"), ("A Borrower Sale.pdf", "sale_notice"), ("Corrigendum to notice", "sale_notice"), ("NIT papers 2", "publication"), ("tender", "tender"), ("photo", "unknown"),
]


@query(f"SELECT role, count(*) AS n FROM (SELECT CASE p_partkey % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_LABELS)) + " END AS role FROM part) GROUP BY 1")
def document_roles(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x, _ in _LABELS]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(N.document_role(label).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'bn-' WHEN 'F' THEN 'be-' ELSE '' END || o_orderkey AS auction_id FROM orders")
def auction_ids(spark, sf_dir):
    prefix = F.when(F.col("o_orderstatus") == "O", "bn-").when(F.col("o_orderstatus") == "F", "be-").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.auction_id(prefix, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("auction_id"))


@query("SELECT 'arm ' || lower(replace(n_name, '_', ' ')) AS key, 3 AS spellings FROM nation")
def branch_keys(spark, sf_dir):
    """Three spellings of a branch have one key."""
    name = F.regexp_replace("n_name", "_", " ")
    spelt = F.explode(F.array(F.concat(F.lit("ARM Branch "), name), F.concat(F.lit("The "), name, F.lit(" ARM Br.")), F.concat(F.lit("arm-"), F.lower(name)))).alias("spelling")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", spelt).withColumn("words", N.branch_key(F.col("spelling")))
    # words are in order of the alphabet; numbers come first there, so the name is put together again
    key = F.concat(F.lit("arm nation "), F.regexp_extract("words", r"(\d+)", 1))
    return rows.groupBy("n_nationkey", key.alias("key")).agg(F.count_distinct("words").alias("forms"), F.count("*").alias("spellings")).where("forms = 1").select("key", "spellings")


@query("SELECT o_orderkey, (o_orderkey % 90 + 10) || '/' || CAST(o_custkey % 9 + 1 AS INT) || 'a' AS value FROM orders")
def family_values(spark, sf_dir):
    """Identifiers in several notations."""
    a, b = (F.col("o_orderkey") % 90 + 10).cast("string"), (F.col("o_custkey") % 9 + 1).cast("int").cast("string")
    between = F.element_at(F.array(F.lit(" BY "), F.lit(" - "), F.lit("/ ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.family_value(F.concat(a, between, b, F.lit("A "))).alias("value"))


@query("SELECT event_id, '{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}' AS body FROM (SELECT event_id, unnest(['user', 'at', 'kind']) AS k, unnest([CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type]) AS v FROM events) GROUP BY 1")
def sorted_json(spark, sf_dir):
    """A JSON text with keys in order and times as ISO text."""
    held = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("kind"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(held)))).alias("body"))


@query("SELECT 'orders' AS label, unnest(['o_custkey', 'o_orderkey', 'o_orderstatus']) AS property, unnest([count(o_custkey), count(o_orderkey), count(o_orderstatus)]) AS held FROM orders")
def row_properties(spark, sf_dir):
    """Keys of rows as maps, and how many rows have a value for each."""
    names = ["o_custkey", "o_orderkey", "o_orderstatus"]
    held = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names])), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select(F.explode(F.map_keys(held)).alias("property")).groupBy(F.lit("orders").alias("label"), "property").agg(F.count("*").alias("held"))


# matching --------------------------------------------------------------------


def _candidates(spark, sf_dir):
    """Orders as candidates of two sources that share banks, days, prices and borrowers now and then."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("source"), (F.col("o_custkey") % 5).alias("bank"), F.trunc("o_orderdate", "month").alias("day"), (F.col("o_orderkey") % 3).alias("price"), (F.col("o_custkey") % 4).alias("borrower"), F.when(F.col("o_orderkey") % 5 < 3, F.concat(F.lit("F/"), (F.col("o_orderkey") % 4).cast("string"))).alias("unit"))
    return o.withColumn("unit", M.unit_key(F.col("unit"))).withColumn("price", F.col("price").cast("double"))


_CANDIDATES = "WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, o_custkey % 5 AS bank, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(o_orderkey % 3 AS DOUBLE) AS price, o_custkey % 4 AS borrower, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 4 AS VARCHAR) END AS unit FROM orders), "
_JUDGED = (
    _CANDIDATES
    + "p AS (SELECT s.id, s.unit, t.id AS other, t.unit AS other_unit, s.price = t.price AS by_price, s.borrower = t.borrower AS by_borrower FROM c s JOIN c t ON s.source = 'a' AND t.source = 'b' AND s.bank = t.bank AND s.day = t.day), "
    "g AS (SELECT id, count(*) FILTER (by_price) AS n_price, count(*) FILTER (by_borrower) AS n_person, count(*) FILTER (by_price AND by_borrower) AS n_both, min(other) FILTER (by_price AND by_borrower) AS sole, bool_or(by_price AND by_borrower AND unit <> other_unit) AS differ, count(*) FILTER (by_price AND by_borrower AND unit = other_unit) AS n_unit, min(other) FILTER (by_price AND by_borrower AND unit = other_unit) AS of_unit FROM p GROUP BY 1), "
    "r AS (SELECT c.id, CASE WHEN coalesce(n_price, 0) = 0 AND coalesce(n_person, 0) = 0 THEN 'new' WHEN n_both = 1 AND coalesce(differ, FALSE) THEN 'units_disagree' WHEN n_both = 1 THEN 'four_fields' WHEN n_both > 1 AND n_unit = 1 THEN 'unit_number' WHEN n_both > 1 THEN 'batch' WHEN n_person = 0 THEN 'price_only' WHEN n_price = 0 THEN 'borrower_only' ELSE 'split' END AS reason, sole, of_unit FROM c LEFT JOIN g USING (id) WHERE source = 'a'), "
    "o AS (SELECT id, reason, CASE reason WHEN 'four_fields' THEN sole WHEN 'unit_number' THEN of_unit END AS other FROM r), "
    "f AS (SELECT id, CASE WHEN other IS NOT NULL AND count(*) OVER (PARTITION BY other) > 1 THEN 'contested' ELSE reason END AS reason, other FROM o), "
    "v AS (SELECT id, CASE WHEN reason = 'new' THEN 'new' WHEN reason IN ('four_fields', 'unit_number') THEN 'link' ELSE 'review' END AS verdict, reason, CASE WHEN reason IN ('four_fields', 'unit_number') THEN other END AS other FROM f) "
)


@query(_CANDIDATES + "t AS (SELECT *, CASE WHEN unit IS NULL THEN id ELSE min(id) OVER (PARTITION BY source, bank, day, unit, round(price), borrower) END AS twin FROM c) SELECT twin, count(*) AS postings FROM t GROUP BY 1")
def unit_twins(spark, sf_dir):
    return M.unit_twins(_candidates(spark, sf_dir)).groupBy("twin").agg(F.count("*").alias("postings"))


def _verdicts(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return M.four_field_verdicts(rows.where("source = 'a'"), rows.where("source = 'b'"))


@query(_JUDGED + "SELECT * FROM v")
def four_field_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(_JUDGED + ", d AS (SELECT id, min(CASE WHEN id % 16 = 0 THEN id + 1 END) AS yes, bool_or(id % 16 <> 0 AND other = id + 1) AS no FROM v WHERE id % 8 = 0 AND id % 3 <> 0 GROUP BY 1) SELECT v.id, CASE WHEN yes IS NOT NULL THEN 'link' WHEN no THEN 'new' ELSE verdict END AS verdict, CASE WHEN yes IS NOT NULL THEN 'decision' WHEN no THEN 'rejected' ELSE reason END AS reason, CASE WHEN yes IS NOT NULL THEN yes WHEN no THEN NULL ELSE other END AS other FROM v LEFT JOIN d USING (id)")
def decided_matches(spark, sf_dir):
    """Decisions on every eighth listing; those made on old facts (every third) are ignored."""
    found = stored(_verdicts(spark, sf_dir), "verdicts")
    facts = found.select("id", F.lit("now").alias("snapshot"))
    made = found.where("id % 8 = 0").select("id", (F.col("id") + 1).alias("other"), (F.col("id") % 16 == 0).alias("approved"), F.when(F.col("id") % 3 == 0, "then").otherwise("now").alias("snapshot"))
    return M.decided(found, made, facts)


@query("WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'R' THEN 'CONFIRMED' WHEN 'A' THEN 'PROBABLE' ELSE 'POSSIBLE' END AS grade FROM lineitem) SELECT a, b, CASE WHEN bool_or(grade = 'CONFIRMED') THEN 'CONFIRMED' WHEN bool_or(grade = 'PROBABLE') THEN 'PROBABLE' ELSE 'POSSIBLE' END AS grade, count(*) AS edges FROM e GROUP BY 1, 2")
def strongest_edges(spark, sf_dir):
    grade = F.when(F.col("l_returnflag") == "R", "CONFIRMED").when(F.col("l_returnflag") == "A", "PROBABLE").otherwise("POSSIBLE")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), grade.alias("grade"))
    return M.strongest(edges, ["a", "b"], "grade", ["CONFIRMED", "PROBABLE", "POSSIBLE"])


@query("WITH n AS (SELECT o_orderkey AS id, o_custkey AS body FROM orders), k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS body FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0), h AS (SELECT id, count(*) AS c, min(body) AS body FROM k GROUP BY 1) SELECT n.id, CASE WHEN c IS NULL THEN 'new' WHEN c > 1 THEN 'ambiguous' WHEN h.body = n.body THEN 'known' ELSE 'variant' END AS state FROM n LEFT JOIN h USING (id)")
def row_difference(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("body"))
    known = new.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.col("body") + 1).otherwise(F.col("body")).alias("body"))
    return M.compared_rows(new, known.unionByName(new.where("id % 7 = 0 AND id % 3 <> 0")), "id", ["body"])


@query("WITH w AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT a.o_custkey, count(*) AS links FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.day <> b.day GROUP BY 1")
def transitive_links(spark, sf_dir):
    """How many pairs a group's expansion has, those of one day left out; counted from the sizes of days, not by listing pairs."""
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    pairs = days.groupBy("o_custkey").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("links"))
    return pairs.where("links > 0")


# merging ---------------------------------------------------------------------


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS portal, CASE l_linenumber % 4 WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice * 1.002 WHEN 3 THEN l_extendedprice * 10 END AS notice FROM lineitem), v AS (SELECT *, CASE WHEN portal IS NULL OR notice IS NULL THEN 'unknown' WHEN l_linenumber % 4 = 2 OR l_linenumber % 4 = 1 THEN 'agree' ELSE 'magnitude_slip' END AS agreement FROM p) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN agreement = 'agree' THEN portal WHEN agreement = 'unknown' THEN coalesce(portal, notice) ELSE notice END, 2) AS price, CASE WHEN agreement = 'agree' THEN 'portal' WHEN agreement = 'unknown' THEN CASE WHEN portal IS NOT NULL THEN 'portal' WHEN notice IS NOT NULL THEN 'notice' END ELSE 'notice' END AS source, agreement FROM v")
def picked_prices(spark, sf_dir):
    """Which of portal's and notice's price counts for each lot."""
    p = F.col("l_extendedprice").cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 1, p).alias("portal"), F.element_at(F.array(F.lit(None).cast("double"), p, p * 1.002, p * 10), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("notice"))
    best = M.picked_price(F.col("portal"), F.col("notice"), A.agreement("portal", "notice")).alias("m")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", best).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("m.price", 2).alias("price"), "m.source", "m.agreement")


@query("WITH k AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS one, split_part(p_type, ' ', 3) AS two FROM part) SELECT one, two, count(*) AS n, CASE WHEN one = 'ECONOMY' AND two IN ('BRASS', 'TIN') THEN 'high' WHEN one = 'ECONOMY' OR two = 'STEEL' THEN 'low' END AS severity FROM k GROUP BY 1, 2")
def type_conflicts(spark, sf_dir):
    """Two types of a lot that don't go together, with how much it matters."""
    rows = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("one"), F.split_part("p_type", F.lit(" "), F.lit(3)).alias("two"))
    severity = F.when((F.col("one") == "ECONOMY") & F.col("two").isin("BRASS", "TIN"), "high").when((F.col("one") == "ECONOMY") | (F.col("two") == "STEEL"), "low")
    return rows.groupBy("one", "two").agg(F.count("*").alias("n")).withColumn("severity", severity)


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n >= 10 THEN '10+' ELSE CAST(n AS VARCHAR) END AS size, count(*) AS events, sum(n) AS listings FROM s GROUP BY 1")
def event_histogram(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") >= 10, "10+").otherwise(F.col("n").cast("string")).alias("size")).agg(F.count("*").alias("events"), F.sum("n").alias("listings"))


_CLUES = {"boundary": "boundar|north|south", "extent": "sq|cent|acre", "possession": "possession"}


@query("SELECT doc_id, " + ", ".join(f"NOT regexp_matches(lower(coalesce(text, '')), '{p}') AS no_{k}" for k, p in _CLUES.items()) + " FROM documents")
def absence_marks(spark, sf_dir):
    """What a text has no clue of, so that a missing value is an absence and not an omission."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *[(~text.rlike(p)).alias(f"no_{k}") for k, p in _CLUES.items()])


@query(f"WITH {LOTS_SQL} SELECT listing_id, lot_no, row_number() OVER (PARTITION BY listing_id ORDER BY deadline NULLS LAST, lot_no) AS new_no FROM lots")
def lot_renumber(spark, sf_dir):
    """Lots numbered again from 1 in order of their place."""
    order = Window.partitionBy("listing_id").orderBy(F.col("deadline").asc_nulls_last(), "lot_no")
    return lots(spark, sf_dir).select("listing_id", "lot_no", F.row_number().over(order).alias("new_no"))


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'consensus' ELSE 'contested' END AS verdict, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value, count(*) AS readings FROM lineitem GROUP BY 1")
def consensus_values(spark, sf_dir):
    """Readings of one thing that all agree, and those that don't."""
    one = F.count_distinct("l_returnflag") == 1
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.when(one, "consensus").otherwise("contested").alias("verdict"), F.when(one, F.min("l_returnflag")).alias("value"), F.count("*").alias("readings"))


@query("WITH d AS (SELECT *, (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (text IS NOT NULL)::INT AS filled FROM documents) SELECT n_chars, arg_min(doc_id, (-filled)::BIGINT * 1000000000 + doc_id) AS doc_id, max(filled) AS filled, count(*) AS copies FROM d GROUP BY 1")
def richest_copy(spark, sf_dir):
    """Of texts of one size the one with the most fields."""
    return M.richest(table(spark, sf_dir, "documents"), ["n_chars"], ["lang", "source", "text"], "doc_id")


# review ----------------------------------------------------------------------


@query(f"{LISTINGS_SQL} SELECT listing_id, CASE WHEN reserve IS NULL THEN 0 WHEN reserve > 300000 THEN 1 ELSE 2 END AS urgency, auction_dt FROM listings WHERE category IS NULL OR status = 'P' ORDER BY urgency, auction_dt NULLS LAST, listing_id LIMIT 50")
def classification_queue(spark, sf_dir):
    """What a reviewer sees first: the urgent, then the oldest."""
    rows = listings(spark, sf_dir).where("category IS NULL OR status = 'P'")
    urgency = F.when(F.col("reserve").isNull(), 0).when(F.col("reserve") > 300_000, 1).otherwise(2)
    return rows.select("listing_id", urgency.alias("urgency"), "auction_dt").orderBy("urgency", F.col("auction_dt").asc_nulls_last(), "listing_id").limit(50)


@query("WITH d AS (SELECT doc_id, source, n_chars, length(coalesce(text, '')) AS chars FROM documents) SELECT source, count(*) AS waiting, count(CASE WHEN chars = 0 THEN 1 END) AS empty, max(n_chars) AS longest, count(CASE WHEN chars <> n_chars THEN 1 END) AS differ FROM d GROUP BY 1")
def extraction_queue(spark, sf_dir):
    """What waits to be read, by source."""
    d = table(spark, sf_dir, "documents").withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    return d.groupBy("source").agg(F.count("*").alias("waiting"), F.count(F.when(F.col("chars") == 0, 1)).alias("empty"), F.max("n_chars").alias("longest"), F.count(F.when(F.col("chars") != F.col("n_chars"), 1)).alias("differ"))


@query(f"{LISTINGS_SQL}, {LOTS_SQL}, s AS (SELECT listing_id, sum(lot_reserve) AS total FROM lots GROUP BY 1) SELECT listing_id, round(reserve, 2) AS reserve, round(total, 2) AS total, round(total / reserve, 4) AS ratio FROM listings JOIN s USING (listing_id) WHERE abs(total - reserve) > 0.1 * reserve")
def price_check_queue(spark, sf_dir):
    """Listings whose lots don't add up to their price."""
    sums = lots(spark, sf_dir).groupBy("listing_id").agg(F.sum("lot_reserve").alias("total"))
    rows = listings(spark, sf_dir).select("listing_id", "reserve").join(sums, "listing_id").where("abs(total - reserve) > 0.1 * reserve")
    return rows.select("listing_id", F.round("reserve", 2).alias("reserve"), F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("reserve"), 4).alias("ratio"))


@query("WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'undo' ELSE event_type END AS action FROM events), n AS (SELECT *, lead(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e) SELECT user_id, event_id, ts, action FROM n WHERE action <> 'undo' AND coalesce(next, '') <> 'undo' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def decision_log(spark, sf_dir):
    """Decisions in force after undos."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "view", "undo").otherwise(F.col("event_type")).alias("action"))
    return M.latest_decisions(log, "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "action")


@query(f"WITH {LOTS_SQL} SELECT listing_id, lot_no, lag(lot_no) OVER w AS before, lead(lot_no) OVER w AS after, count(*) OVER (PARTITION BY listing_id) AS siblings FROM lots WINDOW w AS (PARTITION BY listing_id ORDER BY lot_no)")
def lot_siblings(spark, sf_dir):
    """Each lot's neighbours in its notice, by place."""
    order = Window.partitionBy("listing_id").orderBy("lot_no")
    return lots(spark, sf_dir).select("listing_id", "lot_no", F.lag("lot_no").over(order).alias("before"), F.lead("lot_no").over(order).alias("after"), F.count("*").over(Window.partitionBy("listing_id")).alias("siblings"))


@query("SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'purchase' AND value < 10 ORDER BY ts DESC, event_id LIMIT 40")
def feedback_listing(spark, sf_dir):
    """Open feedback with a low rating, newest first."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'purchase' AND value < 10")
    return rows.select("event_id", "user_id", "ts", "value").orderBy(F.desc("ts"), "event_id").limit(40)


@query("WITH c AS (SELECT lang, source, count(*) AS n, count(DISTINCT text) AS texts, avg(n_chars) AS mean FROM documents GROUP BY 1, 2) SELECT lang, source, n, texts, round(mean, 2) AS mean_chars, round(100.0 * (n - texts) / n, 2) AS repeated FROM c")
def batch_quality(spark, sf_dir):
    """Each batch's size, share of repeated texts and mean length."""
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.avg("n_chars").alias("mean"))
    return d.select("lang", "source", "n", "texts", F.round("mean", 2).alias("mean_chars"), F.round(100 * (F.col("n") - F.col("texts")) / F.col("n"), 2).alias("repeated"))


@query("WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, 'top' AS list FROM (SELECT * FROM s ORDER BY n DESC, user_id LIMIT 5) UNION ALL SELECT user_id, n, 'bottom' FROM (SELECT * FROM s ORDER BY n, user_id LIMIT 5)")
def engagement_ends(spark, sf_dir):
    """The most and the least active."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "user_id").limit(5).withColumn("list", F.lit("top")).unionByName(s.orderBy("n", "user_id").limit(5).withColumn("list", F.lit("bottom")))


@query("SELECT o_custkey, count(*) AS size, min(o_orderkey) AS seed FROM orders GROUP BY 1 HAVING count(*) >= 4")
def cluster_seeds(spark, sf_dir):
    """Clusters large enough to start from, with their first member."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"), F.min("o_orderkey").alias("seed")).where("size >= 4")


@query("WITH l AS (SELECT l_orderkey, count(*) AS links, count(DISTINCT l_suppkey) AS banks, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY 1) SELECT CASE WHEN banks > 4 AND days > 4 THEN 'contradicts' WHEN banks > 4 THEN 'banks' WHEN days > 4 THEN 'days' ELSE 'sound' END AS state, count(*) AS groups, sum(links) AS links FROM l GROUP BY 1")
def link_audit(spark, sf_dir):
    """Groups of links that can't all be right; a writer stops if any contradicts."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("links"), F.count_distinct("l_suppkey").alias("banks"), F.count_distinct(F.to_date("l_shipdate")).alias("days"))
    state = F.when((F.col("banks") > 4) & (F.col("days") > 4), "contradicts").when(F.col("banks") > 4, "banks").when(F.col("days") > 4, "days").otherwise("sound")
    return g.groupBy(state.alias("state")).agg(F.count("*").alias("groups"), F.sum("links").alias("links"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1 HAVING bool_or(contains(lower(text), 'the')) ORDER BY turns DESC, conv_id LIMIT 30")
def dossier_list(spark, sf_dir):
    """Threads that mention a word, the longest first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.bool_or(F.contains(F.lower("text"), F.lit("the"))).alias("hit"))
    return c.where("hit").drop("hit").orderBy(F.desc("turns"), "conv_id").limit(30)


# tables and functions ---------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def rebuilt_table(spark, sf_dir):
    """A sink that is built anew: the second write replaces the first whole."""
    path = scratch_path(spark, "rebuilt")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for part in (0, 1):
        rows.where(F.col("o_orderkey") % 2 == part).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SELECT 'first' AS run, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'second', count(*), min(o_orderkey), max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1")
def audit_log(spark, sf_dir):
    """A log that is only added to: a line for each run."""
    path = scratch_path(spark, "audit")
    rows = table(spark, sf_dir, "orders")
    for i, run in enumerate(("first", "second")):
        rows.where(F.col("o_orderkey") % 2 == i).agg(F.lit(run).alias("run"), F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'csv' AS via FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 'json' FROM nation WHERE n_nationkey % 2 = 1")
def exported_rows(spark, sf_dir):
    """Rows written as CSV and as JSON and read back; a key in both comes from JSON."""
    path = scratch_path(spark, "export")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    rows.write.option("header", True).csv(f"{path}/csv")
    rows.where(F.col("id").cast("int") % 2 == 1).write.json(f"{path}/json")
    a = spark.read.option("header", True).schema("id string, name string").csv(f"{path}/csv").withColumn("via", F.lit("csv"))
    b = spark.read.schema("id string, name string").json(f"{path}/json").withColumn("via", F.lit("json"))
    return a.join(b, "id", "left_anti").unionByName(b)


@query("SELECT page_id, 'pages/' || substr(md5(url), 1, 2) || '/' || md5(url) || '.html' AS object_key FROM pages")
def object_keys(spark, sf_dir):
    """A place in a store that follows from the address alone."""
    name = F.md5(F.col("url").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("pages/"), F.substring(name, 1, 2), F.lit("/"), name, F.lit(".html")).alias("object_key"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 10000000 THEN 'crore' WHEN o_totalprice >= 100000 THEN 'lakh' ELSE 'plain' END AS scale, lower(replace(o_orderstatus || '-' || o_orderkey, ' ', '')) AS slug FROM orders")
def sql_functions(spark, sf_dir):
    """Functions registered for SQL text; they are expressions, which Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION price_scale(p DOUBLE) RETURNS STRING RETURN CASE WHEN p >= 10000000 THEN 'crore' WHEN p >= 100000 THEN 'lakh' ELSE 'plain' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION listing_slug(a STRING, b BIGINT) RETURNS STRING RETURN lower(replace(concat_ws('-', a, b), ' ', ''))")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_for_functions")
    return spark.sql("SELECT o_orderkey, price_scale(o_totalprice) AS scale, listing_slug(o_orderstatus, o_orderkey) AS slug FROM orders_for_functions")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_returnflag, l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def queue_order(spark, sf_dir):
    """A queue's order: kind, then weight, then place."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.orderBy("l_returnflag", F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(None)
def stratified_pick(spark, sf_dir):
    """A reproducible sample that takes from the sources in turn (a sampling operator)."""
    return A.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 60, 7)


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice IS NULL THEN 'price' END, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'old' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL)) AS kind FROM orders) GROUP BY 1")
def stage_panel(spark, sf_dir):
    """What holds listings up at a stage, each reason counted."""
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice").isNull(), "price"), F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "old"), F.when(F.col("o_orderstatus") == "P", "status")))
    return table(spark, sf_dir, "orders").select(F.explode(reasons).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{LISTINGS_SQL}, h AS (SELECT * FROM listings WHERE state = 'ASIA'), v AS (SELECT 'city' AS d, city AS value FROM h UNION ALL SELECT 'category', category FROM h), c AS (SELECT d AS dimension, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2) SELECT dimension, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 5 AND (SELECT count(*) FROM h) > 25")
def auction_refine(spark, sf_dir):
    """Two ways to narrow, only where there are more than 25 rows."""
    hit = listings(spark, sf_dir).where("state = 'ASIA'")
    enough = hit.agg((F.count("*") > 25).alias("_enough"))
    top = S.top_values(hit, {"city": F.col("city"), "category": F.col("category")}, 5)
    return top.join(F.broadcast(enough), how="inner").where("_enough").drop("_enough")


@query("SELECT u, count(*) AS n FROM (SELECT CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) END AS u FROM pages) GROUP BY 1")
def pages_by_host(spark, sf_dir):
    """Pages of each source's host."""
    host = F.when(F.contains("url", F.lit("://")), F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf_dir, "pages").groupBy(host.alias("u")).agg(F.count("*").alias("n"))


