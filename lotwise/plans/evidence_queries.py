"""What texts say about a property, and what known properties say about a text: identifiers, excerpts, sounds, fidelity; and a query for each small reader, on texts that Spark writes from the tables, with SQL that knows what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas, identifiers, measures, normalize, places, similarity
from ..operators import access, notices, spans
from ..operators import text as T
from ..sources import tables
from ..sources.scratch import scratch_path
from ..sources.tables import LOTS_SQL, lots, table
from .layout_queries import notices as layout_notices

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _one_of(key: str, texts: list):
    """The text of a row's turn."""
    turn = F.col(key) % len(texts)
    out = texts[-1]
    for i, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(turn == i, t).otherwise(out)
    return out


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(
    """SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN 'flat:' || p_partkey || 'a,plot:' || p_partkey || '/2'
  WHEN 1 THEN CASE WHEN p_partkey >= 10 THEN 'door:' || p_partkey || ',' ELSE '' END || 'survey:' || p_partkey || '/3b1'
  WHEN 2 THEN CASE WHEN p_partkey >= 10 THEN 'plot:' || p_partkey || ',' ELSE '' END || 'villa:' || p_partkey || '0'
  ELSE '' END AS found FROM part"""
)
def identifiers_outside_clauses(spark, sf_dir):
    """Numbers of the property itself; those that bound it, areas and lone digits aren't."""
    n = F.col("p_partkey").cast("string")
    texts = [
        _text("Flat No. ", n, "A, Plot No ", n, "/2 bounded on the North by Plot No ", n, "9, South by Door No ", n, "8; East by road"),
        _text("S.No. ", n, " by 3B1, Old Door No: ", n, "\nWest side: Survey No 77/", n),
        _text("Plot No. ", n, " extent ", n, " sq.ft in Villa ", n, "0"),
        _text("Flat ", n, " sq.ft of land"),
        F.lit("T.S.No 7"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(identifiers.identifiers(_one_of("p_partkey", texts)), ",").alias("found"))


_QUESTION = "What does my document say about the license, and which version?"


@query(
    """WITH h AS (SELECT doc_id, length(text) AS n, term, string_split(lower(text), term) AS parts FROM documents, (VALUES ('license'), ('version')) v(term) WHERE contains(lower(text), term)),
p AS (SELECT doc_id, n, term, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(term) AS place FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM h)),
s AS (SELECT doc_id, place, greatest(0, place - 240) AS s, least(n, place + length(term) + 240) AS e FROM p),
g AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT doc_id, island, min(s) AS s, max(e) AS e, count(*) AS hits FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, place ROWS UNBOUNDED PRECEDING) AS island FROM g) GROUP BY 1, 2),
c AS (SELECT i.doc_id, s, hits, CASE WHEN s > 0 THEN '… ' ELSE '' END || trim(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT)) || CASE WHEN e < length(text) THEN ' …' ELSE '' END AS piece FROM i JOIN documents d ON d.doc_id = i.doc_id),
b AS (SELECT *, 1500 - coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c),
j AS (SELECT doc_id, sum(hits) AS hits, count(*) AS windows, string_agg(CASE WHEN room > 0 THEN substr(piece, 1, room::BIGINT) END, chr(10) ORDER BY s) AS excerpt FROM b GROUP BY 1)
SELECT doc_id, coalesce(hits, 0)::BIGINT AS hits, coalesce(windows, 0) AS windows, coalesce(excerpt, substr(coalesce(text, ''), 1, 1500)) AS excerpt FROM documents LEFT JOIN j USING (doc_id)"""
)
def dossier_answers(spark, sf_dir):
    """Every document's excerpts around a question's words."""
    return T.dossier_excerpts(table(spark, sf_dir, "documents"), "doc_id", "text", _QUESTION)


_TAMIL = ["கா", "ம்பி", "டூ", "ழை", "சோ", "ந", "ரீ", "வெ", "ல", "பு"]
_LATIN = ["Gaa", "mbi", "dhu", "zhai", "cho", "na", "ree", "we", "la", "bu"]
_SOUND = ["ka", "mpi", "tu", "la", "su", "na", "ri", "vi", "la", "pu"]


def _spelt(key: str, syllables: list[str]):
    pairs = F.create_map(*[F.lit(x) for i, s in enumerate(syllables) for x in (str(i), s)])
    return F.array_join(F.transform(F.filter(F.split(F.col(key).cast("string"), ""), lambda c: c != ""), lambda c: pairs[c]), "")


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(CAST(s_suppkey AS VARCHAR), ''), lambda c: [" + ", ".join(f"'{s}'" for s in _SOUND) + "][CAST(c AS INT) + 1]), '') AS sound, true AS same, 'II' AS part, 's' AS initials FROM supplier")
def tamil_names(spark, sf_dir):
    """Names in Tamil script and in Latin spellings meet in one key."""
    tamil, latin = _text("071  ", _spelt("s_suppkey", _TAMIL), " (நகர்)"), _spelt("s_suppkey", _LATIN)
    shape = places.village_shape(_text("S. ", latin, " - II"))
    sound = places.sound_key(places.tamil_sounds(tamil))
    return table(spark, sf_dir, "supplier").select("s_suppkey", sound.alias("sound"), (sound == places.sound_key(latin)).alias("same"), shape["part"].alias("part"), shape["initials"].alias("initials"))


@query(
    f"""WITH {LOTS_SQL}, p AS (SELECT listing_id, lot_no, coalesce(lot_type, 'PLAIN') AS d FROM lots),
s AS (SELECT listing_id, 20 * (CASE WHEN lot_no % 2 = 0 THEN 100.0 ELSE 0.0 END)::DOUBLE / 100 AS price, 10 * (CASE WHEN listing_id % 2 = 1 THEN 100.0 ELSE 0.0 END)::DOUBLE / 100 AS borrower, CASE WHEN lot_no % 3 = 1 THEN 100.0::DOUBLE ELSE 100 * (1 - 1.0::DOUBLE / length(d)) END AS coverage FROM p WHERE lot_no % 3 > 0),
m AS (SELECT listing_id, count(*) AS properties, round(avg(0.7::DOUBLE * coverage + price + borrower), 1) AS score FROM s GROUP BY 1)
SELECT DISTINCT listing_id AS notice_id, coalesce(properties, 0) AS properties, score FROM p LEFT JOIN m USING (listing_id)"""
)
def notice_fidelity(spark, sf_dir):
    """Scores of notices by their lots' descriptions (some with a letter misread, some missing), prices and borrowers."""
    name = F.coalesce("lot_type", F.lit("PLAIN"))
    described = F.when(F.col("lot_no") % 3 == 1, name).when(F.col("lot_no") % 3 == 2, F.concat(F.substring(name, 1, 2), F.lit("¤"), F.expr("substring(coalesce(lot_type, 'PLAIN'), 4)")))
    price = F.when(F.col("lot_no") % 2 == 0, F.floor("lot_reserve")).otherwise(99_999_999_999)
    known = lots(spark, sf_dir).select(F.col("listing_id").alias("notice_id"), described.alias("described"), price.alias("price"), F.when(F.col("listing_id") % 2 == 1, "terms APPLY").otherwise("").alias("borrower"))
    return spans.fidelity(layout_notices(spark, sf_dir), known, "notice_id", "text", "described", "price", "borrower")


_P = "CAST(floor(o_totalprice) AS BIGINT)"


@query(
    f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_P}::DOUBLE END AS clean, CASE o_orderkey % 4 WHEN 0 THEN {_P}::DOUBLE WHEN 1 THEN {_P} * 100000.0::DOUBLE WHEN 2 THEN ({_P} + 0.5::DOUBLE) * 10000000 END AS money, "
    f"CASE o_orderkey % 4 WHEN 0 THEN {_P}::VARCHAR WHEN 1 THEN ({_P} * 100000)::VARCHAR WHEN 2 THEN ({_P} * 10000000 + 5000000)::VARCHAR ELSE '' END AS amounts FROM orders"
)
def money_read(spark, sf_dir):
    p = F.floor("o_totalprice").cast("string")
    text = _one_of("o_orderkey", [_text("₹", p), _text(p, " lakh"), _text("Rs ", p, ".5 cr"), F.lit("none")])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", normalize.clean_price(F.col("t")).alias("clean"), normalize.parse_money(F.col("t")).alias("money"), F.array_join(measures.amounts_in(F.col("t")), ",").alias("amounts"))


@query(
    "SELECT l_orderkey % 4 AS way, CAST(l_quantity AS INT) AS q, count(*) AS n, CASE l_orderkey % 4 WHEN 0 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE WHEN 1 THEN round((CAST(l_quantity AS INT) + 0.5::DOUBLE) * 3.28084::DOUBLE, 2) WHEN 2 THEN CAST(l_quantity AS INT)::DOUBLE END AS feet FROM lineitem GROUP BY ALL"
)
def lengths_read(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    text = _one_of("l_orderkey", [_text(q, " ft 6 in"), _text(q, ".5 m"), q, _text(q, " sq ft")])
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("way"), F.col("l_quantity").cast("int").alias("q"), measures.length_feet(text).alias("feet"))
    return rows.groupBy("way", "q", "feet").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'road' WHEN 1 THEN 'plot' WHEN 2 THEN 'setback' WHEN 3 THEN 'channel' WHEN 4 THEN 'other' END AS touches, CASE p_partkey % 6 WHEN 0 THEN p_partkey::DOUBLE END AS width, "
    "CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 1.0::DOUBLE ELSE p_size + 2.0::DOUBLE END AS headline FROM part"
)
def neighbours_and_headlines(spark, sf_dir):
    """What a side touches and how wide a road is; which extent stands for a lot of each bucket."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("double")
    side = _one_of("p_partkey", [_text(n, " feet Road"), F.lit("property of P Kumar"), _text("Set back of ", n, " ft, road"), F.lit("Odai"), F.lit("compound wall"), F.lit(None).cast("string")])
    extents = F.create_map(F.lit("uds"), F.lit(1.0), F.lit("built_up"), size, F.lit("total"), size + 1, F.lit("extent"), size + 2)
    some = F.when(F.col("p_partkey") % 3 == 2, F.map_filter(extents, lambda k, _: ~k.isin("total", "built_up"))).otherwise(extents)
    bucket = _one_of("p_partkey", [F.lit("flat"), F.lit("house"), F.lit("land")])
    return table(spark, sf_dir, "part").select("p_partkey", measures.adjacency(side).alias("touches"), measures.road_width(side).alias("width"), measures.headline(some, bucket).alias("headline"))


@query(
    "SELECT s_suppkey, 'plot ' || s_suppkey || ' of kumar' AS north, 'road' AS south, 'property ' || s_nationkey AS east, CASE WHEN s_suppkey % 2 = 0 THEN 'channel' END AS west, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN s_suppkey % 2 = 0 ELSE false END AS agree FROM supplier"
)
def boundaries_read(spark, sf_dir):
    """Sides of a property as stated, and whether three agree with another statement."""
    n, m = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    west = F.when(F.col("s_suppkey") % 2 == 0, " West - Channel").otherwise("")
    one = _text("Bounded on the North by: Plot ", n, " of Kumar; South: Road, Eastern side by Property ", m, ".", west)
    other = _one_of("s_suppkey", [_text("north by plot ", n, " of kumar; south by 20 feet road; east by property ", m), _text("north by plot ", n, "; south by lane; east by property ", m, "; west by channel"), F.lit("north by x; south by y")])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", notices.boundaries(one).alias("a"), notices.boundaries(other).alias("b"))
    return rows.select("s_suppkey", *(F.try_element_at("a", F.lit(s)).alias(s) for s in ("north", "south", "east", "west")), notices.boundaries_agree("a", "b").alias("agree"))


@query(
    "SELECT c_custkey, 'bn-' || c_custkey || ',' || (400000 + c_custkey % 100000) AS portal, '72/1b' || (c_custkey % 10) || ',' || c_custkey || '/3' AS strict, "
    "CASE WHEN c_custkey BETWEEN 10 AND 99999 AND NOT (c_custkey BETWEEN 1900 AND 2099) AND c_custkey <> 72 THEN '72,' || c_custkey ELSE '72' END AS loose FROM customer"
)
def ids_in_text(spark, sf_dir):
    n = F.col("c_custkey").cast("string")
    first, six = _text("Listing BN-", n, " or ", (400_000 + F.col("c_custkey") % 100_000).cast("string"), "."), _text("survey 72/1B", (F.col("c_custkey") % 10).cast("string"), " and ", n, "/3 of 01-02-2021")
    bare = _text("survey 72 sub ", n, " year 2021 lot 7 file 1234567")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(measures.portal_ids(first), ",").alias("portal"), F.array_join(measures.strict_ids(six), ",").alias("strict"), F.array_join(measures.loose_ids(bare), ",").alias("loose"))


@query("SELECT p_partkey, 100.0::DOUBLE AS sorted, 100.0::DOUBLE AS subset, bit_count(xor(p_partkey::BIGINT, p_size::BIGINT))::INT AS bits FROM part")
def token_ratios(spark, sf_dir):
    """Names with their words in another order, or with words besides, are alike; bits that differ between two keys."""
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", similarity.token_sort_ratio(turned, F.col("p_name")).alias("sorted"), similarity.token_set_ratio(F.concat(turned, F.lit(" besides")), F.col("p_name")).alias("subset"),
        similarity.hamming(F.col("p_partkey").cast("long"), F.col("p_size").cast("long")).alias("bits"),
    )


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'place ' || o_custkey WHEN 1 THEN 'place ' || o_custkey ELSE 'town' END AS area, 'customer ' || o_custkey || ' sons' AS borrower, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, 'sale-no-' || o_orderkey AS slug, o_orderkey || '.5 cents' AS extent, CASE WHEN o_orderkey % 2 = 0 THEN 'city' END AS city FROM orders"
)
def names_folded(spark, sf_dir):
    """Names of areas and borrowers, days, slugs, a text's first extent, and a portal's city where no district is known."""
    n, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    area = _one_of("o_orderkey", [_text(" Place ", c, " Taluk., "), _text("place ", c, " district"), F.lit("TOWN ;")])
    borrower = _one_of("o_orderkey", [_text("M/s. Customer ", c, " & Sons"), _text("Messrs Customer ", c, " Sons"), _text("Smt. Dr. Customer ", c, ", Sons")])
    day = F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd' 10:30:00'")
    rows = table(spark, sf_dir, "orders").withColumns({"_city": F.lit("city"), "_district": F.when(F.col("o_orderkey") % 2 == 1, "d")})
    return rows.select(
        "o_orderkey", normalize.area_name(area).alias("area"), normalize.borrower_key(borrower).alias("borrower"), normalize.day_of(day).cast("string").alias("day"), normalize.slug(_text("Sale No. ", n, "!")).alias("slug"),
        areas.first_extent(_text("about ", n, ".5 cents or 10 acres")).alias("extent"), access.suppressed_city("_city", "_district").alias("city"),
    )


@query("SELECT o_orderkey::VARCHAR AS auction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM orders")
def listing_files(spark, sf_dir):
    """JSON-lines files written from the orders: of rows with one key the later file's counts."""
    out = scratch_path(spark, "listing-files")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("auction_id"))
    rows.withColumn("state", F.lit("old")).write.json(f"{out}/2024-01")
    rows.where("auction_id % 2 = 0").withColumn("state", F.lit("new")).write.json(f"{out}/2024-02")
    return tables.read_listing_files(spark, f"{out}/*").select("auction_id", "state")


@query("SELECT c_custkey::VARCHAR AS post, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_custkey * 2.0::DOUBLE END AS likes FROM customer")
def post_metrics(spark, sf_dir):
    """A CSV of metrics with blanks and junk in its numbers."""
    out = scratch_path(spark, "post-metrics")
    c = F.col("c_custkey")
    table(spark, sf_dir, "customer").select(c.cast("string").alias(" Post "), F.when(c % 3 == 0, F.when(c % 2 == 0, "n/a").otherwise(" ")).otherwise((c * 2).cast("string")).alias("Likes")).write.option("header", True).csv(out)
    return tables.read_post_metrics(spark, out, ["likes"]).select("post", "likes")


@query("SELECT n_name AS district, r_name AS state, NULL::VARCHAR AS pin FROM nation JOIN region ON n_regionkey = r_regionkey")
def gazetteer_read(spark, sf_dir):
    """A CSV whose columns go by other names."""
    out = scratch_path(spark, "gazetteer")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.select(F.concat(F.lit(" "), "n_name").alias("Dist Name"), F.col("r_name").alias("STATE")).write.option("header", True).csv(out)
    return tables.read_gazetteer(spark, out, {"district": ["district", "dist name"], "state": ["state"], "pin": ["pin", "pincode"]})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def stale_rows(spark, sf_dir):
    """Orders with no artefact yet, or one made from another version of them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("version"))
    done = rows.where("o_orderkey % 5 != 0").withColumn("version", F.when(F.col("o_orderkey") % 7 == 0, "stale").otherwise(F.col("version")))
    return tables.unprocessed(rows, done, "o_orderkey", "version").select("o_orderkey")
