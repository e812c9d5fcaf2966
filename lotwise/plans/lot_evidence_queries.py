"""Evidence for lots of listings, on notices whose figures say by construction which lot is whose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..sources.tables import LOTS_SQL, lot_numbers

Q, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# By the notice's number modulo 7: prices apart (given exactly, or nearly), deposits only, prices alike with borrowers,
# with identifiers, with nothing else, and all listings at the first lot's price. Lots of each 11th notice name their listing.
_WAYS = 7


def _notices(spark, sf_dir):
    rows = lot_numbers(spark, sf_dir).select(F.col("listing_id").alias("doc"), F.col("lot_no").alias("lot"), (F.col("listing_id") * 100 + F.col("lot_no")).alias("listing"), (F.col("listing_id") % _WAYS).alias("way"))
    apart = F.col("way").isin(0, 1, 2, 6)
    reserve = F.when(apart, 1_000_000.0 + F.col("lot") * 50_000).otherwise(1_000_000.0)
    rows = rows.withColumns({"reserve": reserve, "emd": reserve / 10})
    who, what = F.array(F.concat(F.lit("owner"), F.col("lot").cast("string"))), F.array(F.lit("common"), F.concat(F.col("lot").cast("string"), F.lit("a")))
    sold = rows.select("doc", "lot", "reserve", "emd", who.alias("borrowers"), what.alias("ids"), F.when(F.col("doc") % 11 == 0, F.col("listing")).alias("portal_aid"))
    price = F.when(F.col("way") == 1, F.col("reserve") * 1.004).when(F.col("way") == 6, 1_050_000.0).when(F.col("way") != 2, F.col("reserve"))
    told = rows.select("doc", "listing", price.alias("price"), F.when(F.col("way") == 2, F.col("emd")).alias("emd"), F.when(F.col("way") == 3, who).alias("borrowers"), F.when(F.col("way") == 4, what).alias("ids"))
    return told, sold


_CASES = f"""WITH {LOTS_SQL}, p AS (SELECT listing_id AS doc, lot_no AS lot, listing_id * 100 + lot_no AS listing, listing_id % 7 AS way, listing_id % 11 = 0 AS claims, count(*) OVER (PARTITION BY listing_id) AS n FROM lots),
t AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN way = 0 THEN 'exact' WHEN way = 1 THEN 'tolerance' WHEN way = 2 THEN 'emd' WHEN way = 3 THEN 'borrower' WHEN way = 4 THEN 'identifier'
  WHEN way = 5 THEN CASE WHEN claims THEN 'portal_aid' ELSE 'ambiguous' END ELSE CASE WHEN claims AND lot <> 1 THEN 'portal_aid_conflict' ELSE 'exact' END END AS tier FROM p)"""
_REASONS = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in E.REASONS.items())


@query(
    f"""{_CASES}, o AS (SELECT *, CASE WHEN tier IN ('ambiguous', 'portal_aid_conflict') THEN NULL WHEN way = 6 AND n > 1 THEN 1 ELSE lot END AS got, way = 6 AND n > 1 AND NOT claims AS shared FROM t),
r AS (SELECT a.listing, string_agg(b.listing::VARCHAR, ',' ORDER BY b.listing) AS rivals, string_agg(b.listing::VARCHAR, ', ' ORDER BY b.listing) AS named FROM o a JOIN o b ON a.doc = b.doc AND a.listing <> b.listing AND a.shared GROUP BY 1)
SELECT doc, listing, CASE WHEN got IS NULL THEN 'unmatched' WHEN shared THEN 'rival' ELSE 'linked' END AS outcome, tier, CAST(got AS INT) AS lot, coalesce(rivals, '') AS rivals,
  CASE WHEN shared THEN 'matched because ' || CASE tier {_REASONS} END || ', but so did ' || named ELSE CASE tier {_REASONS} END END AS reason FROM o LEFT JOIN r USING (listing)"""
)
def lot_explanations(spark, sf_dir):
    """Every listing's lot, its rivals and why."""
    return E.explanations(*_notices(spark, sf_dir))


@query(
    f"""{_CASES} SELECT refused_by, tier, count(*) AS n FROM (SELECT CASE WHEN a.n = 1 OR a.lot = b.lot AND a.way <> 6 THEN NULL WHEN a.way IN (0, 1) THEN 'price' WHEN a.way = 2 THEN 'emd' WHEN a.way = 3 THEN 'borrower' WHEN a.way = 4 THEN 'identifier'
  WHEN a.way = 5 THEN CASE WHEN a.claims THEN 'claim' END WHEN b.lot <> 1 THEN 'price' END AS refused_by, a.tier FROM t a JOIN t b ON a.doc = b.doc) GROUP BY ALL"""
)
def lot_refusals(spark, sf_dir):
    """Which key refused how many pairs of listing and lot."""
    return E.evidence(*_notices(spark, sf_dir)).groupBy("refused_by", "tier").agg(F.count("*").alias("n"))
