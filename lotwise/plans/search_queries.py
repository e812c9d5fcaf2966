"""Search queries over the star tables, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import LISTINGS_SQL, LOTS_SQL, listings, lots, table

AS_OF = datetime(1998, 6, 1)
_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
BANDS = [50_000, 100_000, 200_000, 300_000]
Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def example_filters() -> S.Filters:
    f = S.Filters().keep("service_area", F.col("city").isNotNull())
    f = f.add("state", S.same_text("state", "Asia")).add("price", S.between("reserve", 100_000, 300_000)).add("status", S.any_of("status", ["O", "F"]))
    return f.add("category", S.has_text("category", "build")).add("upcoming", F.col("auction_dt") >= as_of())


_F = {
    "service_area": "city IS NOT NULL",
    "state": "lower(state) = 'asia'",
    "price": "reserve BETWEEN 100000 AND 300000",
    "status": "status IN ('O', 'F')",
    "category": "contains(lower(category), 'build')",
    "upcoming": f"auction_dt >= {_AS_OF}",
}


def _where(*dropped: str) -> str:
    return " AND ".join(v for k, v in _F.items() if k not in dropped)


@query(f"{LISTINGS_SQL} SELECT count(*) AS total, count(reserve) AS priced, min(reserve) AS min_price, max(reserve) AS max_price, round(avg(reserve), 2) AS avg_price, min(auction_dt) AS first_dt, max(auction_dt) AS last_dt FROM listings WHERE {_where()}")
def search_stats(spark, sf_dir):
    return S.stats(example_filters().on(listings(spark, sf_dir)))


@query(f"{LISTINGS_SQL} SELECT listing_id, city, category, reserve, auction_dt FROM listings WHERE {_where()} ORDER BY reserve DESC NULLS LAST, listing_id LIMIT 25")
def search_topk(spark, sf_dir):
    rows = example_filters().on(listings(spark, sf_dir)).select("listing_id", "city", "category", "reserve", "auction_dt")
    return rows.orderBy(*S.sort_columns("price_desc")).limit(S.page_size(25))


@query(f"{LISTINGS_SQL} SELECT listing_id, auction_dt, reserve FROM listings WHERE {_where('upcoming')} ORDER BY CASE WHEN auction_dt IS NULL THEN 2 WHEN auction_dt >= {_AS_OF} THEN 0 ELSE 1 END, CASE WHEN auction_dt >= {_AS_OF} THEN auction_dt END NULLS LAST, auction_dt DESC NULLS LAST, listing_id LIMIT 50 OFFSET 20")
def browse_upcoming_page(spark, sf_dir):
    rows = example_filters().without("upcoming").on(listings(spark, sf_dir)).select("listing_id", "auction_dt", "reserve")
    return rows.orderBy(*S.upcoming_first(rows, "auction_dt", "listing_id", as_of())).offset(20).limit(50)


def _breakdown_sql(value: str, where: str = "city IS NOT NULL") -> str:
    return f"{LISTINGS_SQL} SELECT value, n FROM (SELECT {value} AS value, count(DISTINCT listing_id) AS n FROM listings WHERE {where} GROUP BY 1) WHERE value IS NOT NULL ORDER BY n DESC, value LIMIT 40"


@query(_breakdown_sql("city"))
def breakdown_city(spark, sf_dir):
    return S.breakdown(listings(spark, sf_dir).where("city IS NOT NULL"), F.col("city"), "listing_id")


@query(_breakdown_sql("strftime(auction_dt, '%Y-%m')", _where()))
def breakdown_month(spark, sf_dir):
    return S.breakdown(example_filters().on(listings(spark, sf_dir)), S.month("auction_dt"), "listing_id")


_BAND_SQL = "CASE WHEN reserve IS NULL THEN 'unknown' WHEN reserve < 50000 THEN '0-50000' WHEN reserve < 100000 THEN '50000-100000' WHEN reserve < 200000 THEN '100000-200000' WHEN reserve < 300000 THEN '200000-300000' ELSE '300000+' END"


@query(_breakdown_sql(_BAND_SQL))
def breakdown_price_band(spark, sf_dir):
    return S.breakdown(listings(spark, sf_dir).where("city IS NOT NULL"), S.price_band("reserve", BANDS), "listing_id")


@query(_breakdown_sql("nullif(status, 'P')"))
def breakdown_null_dropped(spark, sf_dir):
    return S.breakdown(listings(spark, sf_dir).where("city IS NOT NULL"), F.nullif(F.col("status"), F.lit("P")), "listing_id")


@query(f"{LISTINGS_SQL} SELECT state, category, count(reserve) AS n, min(reserve) AS low, round(quantile_cont(reserve, 0.25), 4) AS p25, round(quantile_cont(reserve, 0.5), 4) AS median, round(quantile_cont(reserve, 0.75), 4) AS p75, max(reserve) AS high FROM listings GROUP BY ALL")
def price_quantiles(spark, sf_dir):
    return S.quantiles(listings(spark, sf_dir), "reserve", ["state", "category"])


_FACETS = {
    "state": ("state", ["state", "city"]),
    "city": ("city", ["city"]),
    "category": ("category", ["category"]),
    "status": ("status", ["status"]),
    "price_band": (None, ["price"]),
    "source_rank": ("source_rank", []),
}


@query(f"{LISTINGS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({c or _BAND_SQL} AS VARCHAR) AS value, count(*) AS n FROM listings WHERE {_where(*own)} AND {c or _BAND_SQL} IS NOT NULL GROUP BY 2" for n, (c, own) in _FACETS.items()))
def facets_all(spark, sf_dir):
    dims = {n: (F.col(c) if c else S.price_band("reserve", BANDS), own) for n, (c, own) in _FACETS.items()}
    return S.facets(listings(spark, sf_dir), example_filters(), dims)


@query(f"{LISTINGS_SQL}, c AS ({' UNION ALL '.join(f'''SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM listings WHERE {_where('category')} GROUP BY 2''' for n, c in (('city', 'city'), ('category', 'category'), ('price_band', _BAND_SQL)))}) SELECT dimension, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank FROM c WHERE value IS NOT NULL) WHERE rank <= 3")
def refine_top3(spark, sf_dir):
    rows = example_filters().without("category").on(listings(spark, sf_dir))
    return S.top_values(rows, {"city": F.col("city"), "category": F.col("category"), "price_band": S.price_band("reserve", BANDS)}, 3)


@query(f"{LISTINGS_SQL} SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{x}' AS dropped, count(*) AS n FROM listings WHERE {_where(x)}''' for x in _F if x != 'service_area')}) WHERE n > 0")
def relax_counts(spark, sf_dir):
    return S.relax(listings(spark, sf_dir), example_filters())


@query(f"{LISTINGS_SQL} SELECT count(*) AS total, count(CASE WHEN auction_dt < {_AS_OF} THEN 1 END) AS past FROM listings WHERE {_where('upcoming')}")
def past_matches(spark, sf_dir):
    return example_filters().without("upcoming").on(listings(spark, sf_dir)).agg(F.count("*").alias("total"), F.count(F.when(F.col("auction_dt") < as_of(), 1)).alias("past"))


@query(f"{LISTINGS_SQL}, {LOTS_SQL} SELECT count(*) AS n, round(sum(reserve), 2) AS total FROM listings l WHERE EXISTS (SELECT 1 FROM lots t WHERE t.listing_id = l.listing_id AND extent BETWEEN 10 AND 20 AND possession = 'R')")
def exists_filter(spark, sf_dir):
    hit = lots(spark, sf_dir).where("extent BETWEEN 10 AND 20 AND possession = 'R'").select("listing_id")
    return listings(spark, sf_dir).join(hit, "listing_id", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("reserve"), 2).alias("total"))


@query(f"{LISTINGS_SQL} SELECT listing_id, status, reserve FROM listings l WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_orderkey = l.listing_id)")
def not_exists_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("listing_id"))
    return listings(spark, sf_dir).join(lines, "listing_id", "left_anti").select("listing_id", "status", "reserve")


@query(f"WITH {LOTS_SQL}, r AS (SELECT listing_id, min(lot_no) AS own_lot FROM lots WHERE possession = 'A' GROUP BY 1), c AS (SELECT listing_id, count(DISTINCT lot_no) AS lot_count FROM lots GROUP BY 1) SELECT listing_id, lot_no, lot_count, CASE WHEN own_lot IS NOT NULL OR lot_count = 1 THEN 'lot' ELSE 'notice' END AS scope FROM lots LEFT JOIN r USING (listing_id) JOIN c USING (listing_id) WHERE own_lot IS NULL OR own_lot = lot_no")
def lot_scope(spark, sf_dir):
    every = lots(spark, sf_dir).select("listing_id", "lot_no", "possession")
    resolved = every.where("possession = 'A'").groupBy("listing_id").agg(F.min("lot_no").alias("lot_no"))
    return S.lot_scope(every, resolved)


@query(f"{LISTINGS_SQL}, n AS (SELECT a.listing_id, b.listing_id AS other FROM listings a JOIN listings b ON a.borrower_id = b.borrower_id AND a.status = b.status AND a.listing_id <> b.listing_id AND date_trunc('month', a.auction_dt) = date_trunc('month', b.auction_dt)) SELECT listing_id, source_rank FROM listings l WHERE NOT EXISTS (SELECT 1 FROM n JOIN listings o ON o.listing_id = n.other WHERE n.listing_id = l.listing_id AND (o.source_rank < l.source_rank OR (o.source_rank = l.source_rank AND o.listing_id < l.listing_id)))")
def canonical_copy(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", "borrower_id", "status", "source_rank", F.date_trunc("month", "auction_dt").alias("m"))
    other = rows.select(F.col("listing_id").alias("other"), "borrower_id", "status", "m")
    near = rows.join(other, ["borrower_id", "status", "m"]).where("listing_id <> other").select("listing_id", "other")
    return S.canonical(rows, near).select("listing_id", "source_rank")


_IDS = [7, 3, 999_999_999, 12, 5, 1]


@query(f"SELECT p.position, p.listing_id, o.o_totalprice AS reserve, o.o_orderkey IS NOT NULL AS found FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(_IDS))}) AS p(position, listing_id) LEFT JOIN orders o ON o.o_orderkey = p.listing_id")
def lookup_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("reserve"))
    return S.lookup(rows, _IDS, "listing_id").select("position", "listing_id", "reserve", "found")


@query(f"{LISTINGS_SQL} SELECT listing_id, borrower, city FROM listings WHERE contains(lower(coalesce(borrower, '')), '00012') OR contains(lower(coalesce(city, '')), '00012') OR contains(lower(coalesce(category, '')), 'auto') AND status = 'P'")
def browse_free_text(spark, sf_dir):
    q = lambda c, v: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(v)
    return listings(spark, sf_dir).where(q("borrower", "00012") | q("city", "00012") | (q("category", "auto") & (F.col("status") == "P"))).select("listing_id", "borrower", "city")


@query(f"{LISTINGS_SQL} SELECT state, city, category, count(*) AS n, round(sum(reserve), 2) AS total FROM listings GROUP BY CUBE (state, category), city HAVING city IS NOT NULL")
def cube_places(spark, sf_dir):
    rows = listings(spark, sf_dir).where("city IS NOT NULL")
    return rows.groupingSets([["state", "category", "city"], ["state", "city"], ["category", "city"], ["city"]], "state", "category", "city").agg(F.count("*").alias("n"), F.round(F.sum("reserve"), 2).alias("total"))
