"""Benchmark, chain, merge and report queries over the star tables, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analytics as A
from ..sources.tables import LISTINGS_SQL, LOTS_SQL, listings, lots, table, unless_corrected, upsert

Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def ntz(text: str):
    return F.lit(datetime.fromisoformat(text)).cast("timestamp_ntz")


_RINGS = {"type_in_city": ["lot_type", "city"], "type_in_state": ["lot_type", "state"], "city": ["city"], "type": ["lot_type"]}


def _peers(spark, sf_dir):
    places = listings(spark, sf_dir).select("listing_id", "city", "state")
    rows = lots(spark, sf_dir).where("extent BETWEEN 2 AND 500000").join(places, "listing_id")
    return rows.select("lot_type", "city", "state", (F.col("lot_reserve") / F.col("extent")).alias("unit_price"), (F.col("listing_id") * 1000 + F.col("lot_no")).alias("key"))


def _rings_sql() -> str:
    parts = []
    for name, by in _RINGS.items():
        ring, known = ", ".join(by), " AND ".join(f"{c} IS NOT NULL" for c in by)
        parts.append(
            f"SELECT key, '{name}' AS ring, n, p25, median, p75, below, round(100.0 * below / n, 2) AS percent_below FROM (SELECT key, {ring}, rank() OVER (PARTITION BY {ring} ORDER BY unit_price) - 1 AS below FROM p WHERE {known}) JOIN (SELECT {ring}, count(*) AS n, round(quantile_cont(unit_price, 0.25), 9) AS p25, round(quantile_cont(unit_price, 0.5), 9) AS median, round(quantile_cont(unit_price, 0.75), 9) AS p75 FROM p GROUP BY ALL HAVING count(*) >= 5) USING ({ring})"
        )
    return f"{LISTINGS_SQL}, {LOTS_SQL}, p AS (SELECT lot_type, city, state, lot_reserve / extent AS unit_price, listing_id * 1000 + lot_no AS key FROM lots JOIN listings USING (listing_id) WHERE extent BETWEEN 2 AND 500000) {' UNION ALL '.join(parts)}"


@query(_rings_sql())
def benchmark_rings(spark, sf_dir):
    """Every lot against its rings of peers."""
    peers = _peers(spark, sf_dir)
    return A.benchmark_rings(peers, peers, _RINGS)


@query(f"WITH {LOTS_SQL}, n AS (SELECT listing_id, count(*) AS lot_count, min(extent) AS extent, bool_or(possession = 'A') AS resolved FROM lots GROUP BY 1), r AS (SELECT CASE WHEN o_totalprice IS NULL THEN 'no_reserve' WHEN coalesce(lot_count, 0) = 0 THEN 'no_lots' WHEN lot_count > 1 AND NOT resolved THEN 'several_lots' WHEN extent IS NULL OR NOT extent BETWEEN 10 AND 500000 THEN 'no_extent' END AS reason FROM orders LEFT JOIN n ON listing_id = o_orderkey) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def benchmark_refusals(spark, sf_dir):
    per = lots(spark, sf_dir).groupBy("listing_id").agg(F.count("*").alias("lot_count"), F.min("extent").alias("extent"), F.bool_or(F.col("possession") == "A").alias("resolved"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("reserve")).join(per, "listing_id", "left")
    return rows.select(A.refusal("reserve", "lot_count", "resolved", "extent", (10, 500_000)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, max(p) AS previous_max, count(p) AS earlier FROM (SELECT a.o_orderkey, b.o_totalprice AS p FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate) GROUP BY 1")
def previous_sale(spark, sf_dir):
    return A.previous_sale(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS INT) AS attempt_no, count(*) OVER (PARTITION BY o_custkey) AS chain_size, lag(o_totalprice) OVER w AS previous_price, lag(o_orderkey) OVER w AS previous_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey)")
def attempt_chain(spark, sf_dir):
    return A.attempt_chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


@query("WITH r AS (SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS INT) AS round FROM orders) SELECT *, CASE WHEN round < max(round) OVER (PARTITION BY o_custkey) THEN 'unsold' END AS outcome FROM r")
def distinct_day_rank(spark, sf_dir):
    return A.distinct_day_rank(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


_FIELDS = ["status", "reserve", "auction_dt"]


def _first_sql(f: str) -> str:
    return f"(array_agg({f} ORDER BY source_rank, listing_id) FILTER ({f} IS NOT NULL AND CAST({f} AS VARCHAR) <> ''))[1] AS {f}, (array_agg(listing_id ORDER BY source_rank, listing_id) FILTER ({f} IS NOT NULL AND CAST({f} AS VARCHAR) <> ''))[1] AS {f}_from"


@query(f"{LISTINGS_SQL}, n AS (SELECT listing_id, borrower_id, source_rank, nullif(status, 'P') AS status, CASE WHEN reserve >= 50000 THEN reserve END AS reserve, auction_dt FROM listings) SELECT borrower_id, {', '.join(map(_first_sql, _FIELDS))} FROM n GROUP BY borrower_id")
def source_rank_merge(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"status": F.nullif(F.col("status"), F.lit("P")), "reserve": F.when(F.col("reserve") >= 50_000, F.col("reserve"))})
    return A.first_present(rows, "borrower_id", "source_rank", "listing_id", _FIELDS)


_VERDICT = "CASE WHEN a IS NULL OR b IS NULL OR a <= 0 OR b <= 0 THEN 'unknown' WHEN abs(a - b) <= 0.01 * b THEN 'agree' WHEN abs(greatest(a, b) / least(a, b) - 10) <= 0.5 OR abs(greatest(a, b) / least(a, b) - 100) <= 5 OR abs(greatest(a, b) / least(a, b) - 1000) <= 50 THEN 'magnitude_slip' ELSE 'disagree' END"


@query(f"WITH v AS (SELECT o_orderpriority, o_totalprice AS a, s AS b FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT o_orderpriority, {_VERDICT} AS verdict, count(*) AS n FROM v GROUP BY ALL")
def price_agreement(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("b"))
    rows = table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left").withColumnRenamed("o_totalprice", "a")
    return rows.groupBy("o_orderpriority", A.agreement("a", "b").alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT o_custkey, list_sort(list(CAST(o_orderkey AS VARCHAR))) AS ids FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN len(ids) = 1 THEN 'ev-' || ids[1] ELSE 'ev-' || substr(sha1(array_to_string(ids, '|')), 1, 16) END AS event_id, len(ids) AS members FROM g")
def event_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    return ids.select("o_custkey", A.event_id(F.col("ids")).alias("event_id"), F.size("ids").cast("long").alias("members"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def upsert_listings(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    third = old.where("o_orderkey % 3 = 0")
    new = third.withColumn("price", F.col("price") + 1).unionByName(third.withColumn("o_orderkey", -F.col("o_orderkey")))
    return upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 3 <> 0 THEN o_totalprice ELSE o_totalprice * 2 END AS price, CASE WHEN o_orderstatus = 'P' THEN 'reviewer' END AS corrected_by FROM orders")
def corrected_prices_stay(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "P", "reviewer").alias("corrected_by"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("price") * 2).alias("price"))
    return unless_corrected(old, new, "o_orderkey", "price", "corrected_by")


@query("WITH w AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS copies, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS price, o_orderdate FROM orders) SELECT o_custkey, o_orderstatus, min(o_orderkey) FILTER (i = 1) AS o_orderkey, (array_agg(price ORDER BY o_orderdate DESC, o_orderkey) FILTER (price IS NOT NULL))[1] AS price, any_value(copies) AS copies FROM w GROUP BY 1, 2")
def fill_from_copies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_totalprice") > 150_000, F.col("o_totalprice")))
    return A.fill_from_copies(rows, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey").asc()], ["price"], "o_orderkey")


@query(LISTINGS_SQL + " " + " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS stage, count(*) AS n FROM listings WHERE {' AND '.join(v for v in ['reserve > 20000', 'state IS NOT NULL', '''status <> 'F' ''', '''auction_dt >= TIMESTAMP '1997-01-01' '''][: i + 1])}" for i, n in enumerate(["priced", "placed", "open", "late"])))
def review_funnel(spark, sf_dir):
    return A.funnel(listings(spark, sf_dir), {"priced": F.col("reserve") > 20_000, "placed": F.col("state").isNotNull(), "open": F.col("status") != "F", "late": F.col("auction_dt") >= ntz("1997-01-01")})


_CARD = {"urgent": ("source_rank = 1", "true"), "open": ("status = 'O'", "reserve > 100000"), "placed": ("state IS NOT NULL", "status = 'P'")}


def _card_sql(view: str = "listings") -> str:
    return " UNION ALL ".join(f"SELECT 'listings' AS section, '{n}' AS metric, count(CASE WHEN {h} AND {b} THEN 1 END) AS value, count(CASE WHEN {b} THEN 1 END) AS total, round(100.0 * count(CASE WHEN {h} AND {b} THEN 1 END) / nullif(count(CASE WHEN {b} THEN 1 END), 0), 2) AS pct FROM {view}" for n, (h, b) in _CARD.items())


def _card(rows):
    return A.scorecard(rows, "listings", {n: (F.expr(h), F.expr(b)) for n, (h, b) in _CARD.items()})


@query(f"{LISTINGS_SQL} {_card_sql()}")
def scorecard(spark, sf_dir):
    return _card(listings(spark, sf_dir))


@query(f"{LISTINGS_SQL}, old AS (SELECT * FROM listings WHERE auction_dt < TIMESTAMP '1998-01-01'), a AS ({_card_sql()}), b AS ({_card_sql('old')}) SELECT a.section, a.metric, a.value AS now, b.value AS before, a.value - b.value AS change FROM a JOIN b USING (section, metric)")
def scorecard_change(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return A.scorecard_change(_card(rows), _card(rows.where(F.col("auction_dt") < ntz("1998-01-01"))))


@query(f"WITH {LOTS_SQL}, h AS (SELECT listing_id, lot_no, (epoch(deadline) - epoch(TIMESTAMP '1998-03-01 06:00:00')) / 3600 AS hours FROM lots) SELECT listing_id, lot_no, CASE WHEN hours <= 24 THEN 'urgent' WHEN hours <= 72 THEN 'soon' ELSE 'upcoming' END AS severity, CAST(floor(hours / 24) AS BIGINT) AS days_left FROM h WHERE hours >= 0 AND hours <= 168")
def deadline_alerts(spark, sf_dir):
    severity, days = A.deadline_alert("deadline", ntz("1998-03-01 06:00:00"))
    return lots(spark, sf_dir).select("listing_id", "lot_no", severity.alias("severity"), days.alias("days_left")).where("severity IS NOT NULL")


_SCORE = """, a AS (SELECT *, avg(reserve) OVER (PARTITION BY city) AS area_avg, count(*) OVER (PARTITION BY city) AS n_city, count(*) OVER (PARTITION BY category) AS n_bank, count(auction_dt) OVER (PARTITION BY city) AS n_dated, date_diff('day', TIMESTAMP '1998-06-01', date_trunc('day', auction_dt)) AS days FROM listings),
d AS (SELECT listing_id, least(greatest(100 - (reserve / area_avg - 1) * 100, 0), 100) AS price, least(greatest(40 + 0.5 * n_city, 30), 95) AS location, least(greatest(40 + 0.3 * n_bank, 40), 90) AS bank,
 CASE WHEN days < 0 THEN 0 WHEN days < 3 THEN 60 WHEN days < 14 THEN 90 WHEN days < 30 THEN 80 ELSE 60 END AS urgency, greatest(20, 100 - 2 * n_dated) AS competition, 50 + 10 * (5 - source_rank) AS legal FROM a),
s AS (SELECT listing_id, round(0.2 * price + 0.15 * location + 0.15 * legal + 0.1 * bank + 0.1 * 60 + 0.1 * urgency + 0.05 * 30 + 0.05 * 60 + 0.05 * competition + 0.05 * 50 + 0.0000001, 2) AS score FROM d)"""


@query(f"{LISTINGS_SQL}{_SCORE} SELECT listing_id, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s")
def listing_scores(spark, sf_dir):
    """Ten weighted dimensions; those without a column here hold their stated defaults."""
    rows = listings(spark, sf_dir)
    place = rows.groupBy("city").agg(F.avg("reserve").alias("area_avg"), F.count("*").alias("n_city"), F.count("auction_dt").alias("n_dated"))
    bank = rows.groupBy("category").agg(F.count("*").alias("n_bank"))
    x = rows.join(place, "city", "left").join(bank, "category", "left")
    days = F.datediff(F.to_date("auction_dt"), F.lit("1998-06-01").cast("date"))
    urgency = F.when(days < 0, 0).when(days < 3, 60).when(days < 14, 90).when(days < 30, 80).otherwise(60)
    price, location, bank_ = A.clamp(100 - (F.col("reserve") / F.col("area_avg") - 1) * 100, 0.0, 100.0), A.clamp(40 + 0.5 * F.col("n_city"), 30.0, 95.0), A.clamp(40 + 0.3 * F.col("n_bank"), 40.0, 90.0)
    competition, legal = F.greatest(F.lit(20), 100 - 2 * F.col("n_dated")), 50 + 10 * (5 - F.col("source_rank"))
    score = F.round(0.2 * price + 0.15 * location + 0.15 * legal + 0.1 * bank_ + 0.1 * F.lit(60) + 0.1 * urgency + 0.05 * F.lit(30) + 0.05 * F.lit(60) + 0.05 * competition + 0.05 * F.lit(50) + 1e-7, 2)  # off the ties, where the order of a mean's summands shows
    return x.select("listing_id", score.alias("score")).withColumn("grade", A.grade(F.col("score")))


_MOVES = {"view": ["click", "signup"], "click": ["purchase", "view", "error"], "signup": ["view", "click"], "purchase": ["view"], "error": ["view"]}


@query("WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), k AS (SELECT *, b IS NULL OR (" + " OR ".join(f"(b = '{a}' AND event_type IN ({', '.join(repr(x) for x in to)}))" for a, to in _MOVES.items()) + ") AS ok FROM s) SELECT user_id, (array_agg(event_type ORDER BY ts DESC, event_id DESC) FILTER (ok))[1] AS state, max(ts) FILTER (ok) AS since, count(CASE WHEN NOT ok THEN 1 END) AS refused FROM k GROUP BY user_id")
def tracker_state(spark, sf_dir):
    return A.latest_states(table(spark, sf_dir, "events").withColumnRenamed("event_type", "state"), "user_id", "ts", "event_id", _MOVES)


@query("SELECT event_type, count(*) AS posts, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(sum(value) / count(DISTINCT user_id), 4) AS per_user FROM events GROUP BY 1")
def engagement_report(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("posts"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.round(F.sum("value") / F.countDistinct("user_id"), 4).alias("per_user"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), h AS (SELECT event_type, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b FROM r GROUP BY 1) SELECT event_type, round(a, 4) AS first_half, round(b, 4) AS second_half, CASE WHEN b - a > 0.15 THEN 'up' WHEN b - a < -0.15 THEN 'down' ELSE 'flat' END AS trend FROM h")
def trend_halves(spark, sf_dir):
    return A.trend_halves(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", "value")


@query(f"{LISTINGS_SQL} SELECT listing_id, city, CAST(rank() OVER (PARTITION BY city ORDER BY reserve) AS INT) AS rank, round((reserve / median(reserve) OVER (PARTITION BY city) - 1) * 100, 2) AS above_median_pct, count(*) OVER (PARTITION BY city) AS n FROM listings QUALIFY n >= 5")
def city_context(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", "city", "reserve")
    whole = rows.groupBy("city").agg(F.percentile("reserve", F.lit(0.5)).alias("median"), F.count("*").alias("n")).where("n >= 5")
    # ranks by price, so that a city of any size is split over tasks
    prices = A.counted_before(rows.groupBy("city", "reserve").agg(F.count("*").alias("_n")), "city", ["reserve"], "_n").select(F.col("city").alias("_city"), F.col("reserve").alias("_reserve"), (F.col("_before") + 1).cast("int").alias("rank"))
    ranked = rows.join(prices, F.col("city").eqNullSafe(F.col("_city")) & F.col("reserve").eqNullSafe(F.col("_reserve")))
    return ranked.join(whole, "city").select("listing_id", "city", "rank", F.round((F.col("reserve") / F.col("median") - 1) * 100, 2).alias("above_median_pct"), "n")


@query("WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 4) AS rho FROM r GROUP BY 1")
def spearman(spark, sf_dir):
    return A.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


_Z = "1.959963984540054"


@query(f"WITH c AS (SELECT source, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, hits * 1.0 / n AS p FROM c) SELECT source, n, hits, round(greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n)), 4) AS low, round(least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n)), 4) AS high FROM p WHERE n >= 8")
def spot_check_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = rows.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("hits")).where("n >= 8")
    low, high = A.wilson(F.col("hits"), F.col("n"))
    return c.select("source", "n", "hits", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("WITH g AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0), f AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars < 1500), c AS (SELECT coalesce(g.lang, f.lang) AS lang, count(CASE WHEN g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN g.doc_id IS NULL THEN 1 END) AS fp, count(CASE WHEN f.doc_id IS NULL THEN 1 END) AS fn FROM g FULL JOIN f ON g.lang = f.lang AND g.doc_id = f.doc_id GROUP BY 1) SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c")
def prf_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return A.prf(rows.where("quality = 0"), rows.where("n_chars < 1500"), ["doc_id"], ["lang"])


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM c) SELECT p_brand, p_type, n, total FROM t WHERE n >= 3 AND n >= 0.02 * total")
def majority_learner(spark, sf_dir):
    return A.majority(table(spark, sf_dir, "part"), "p_brand", "p_type", support=3, share=0.02)


@query("WITH p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2) SELECT a, b, n FROM p WHERE n >= 3")
def neighbour_pairs(spark, sf_dir):
    """Banks that share notices, both ways, with enough support."""
    pairs = A.shared_groups(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").where("n >= 3")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


@query("SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS used, CAST(sum(count(*)) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY date_trunc('day', ts)) AS BIGINT) AS month_used, count(*) > 2 AS over_quota FROM events GROUP BY user_id, date_trunc('day', ts), date_trunc('month', ts)")
def quota_windows(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    w = Window.partitionBy("user_id", F.trunc("day", "month")).orderBy("day")
    return days.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "used", F.sum("used").over(w).alias("month_used"), (F.col("used") > 2).alias("over_quota"))


@query("SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("WITH c AS (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_orderkey, round(before - o_totalprice, 2) AS fell FROM c WHERE before - o_totalprice >= 0.05 * before OR before - o_totalprice >= 200000")
def price_drop_gate(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    fell = F.col("before") - F.col("o_totalprice")
    return table(spark, sf_dir, "orders").withColumn("before", F.lag("o_totalprice").over(w)).where((fell >= 0.05 * F.col("before")) | (fell >= 200_000)).select("o_orderkey", F.round(fell, 2).alias("fell"))


@query("SELECT ts, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ts HAVING count(*) >= 2")
def bulk_sweeps(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("ts").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n >= 2")


@query(f"WITH {LOTS_SQL}, f AS (SELECT listing_id, deadline, unnest(list_filter([CASE WHEN extent < 5 THEN 'small' END, CASE WHEN lot_reserve > 50000 THEN 'dear' END, CASE WHEN possession = 'N' THEN 'symbolic' END], lambda x: x IS NOT NULL)) AS flag FROM lots) SELECT flag, count(*) AS n, count(DISTINCT CASE WHEN deadline >= TIMESTAMP '1998-06-01' THEN listing_id END) AS upcoming FROM f GROUP BY 1")
def flag_counts(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("extent") < 5, "small"), F.when(F.col("lot_reserve") > 50_000, "dear"), F.when(F.col("possession") == "N", "symbolic")))
    rows = lots(spark, sf_dir).select("listing_id", "deadline", F.explode(flags).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("deadline") >= ntz("1998-06-01"), F.col("listing_id"))).alias("upcoming"))


@query(f"WITH {LOTS_SQL}, k AS (SELECT listing_id, [min(lot_type) IS NOT NULL, max(lot_reserve) > 30000, min(extent) >= 3, max(bank_id) IS NOT NULL, bool_or(possession = 'A')] AS c FROM lots GROUP BY 1) SELECT o_orderkey AS listing_id, coalesce(len(list_filter(c, lambda x: x)), 0) AS filled, round(100.0 * coalesce(len(list_filter(c, lambda x: x)), 0) / 5, 2) AS pct FROM orders LEFT JOIN k ON listing_id = o_orderkey")
def key_checklist(spark, sf_dir):
    per = lots(spark, sf_dir).groupBy("listing_id").agg(F.array(F.min("lot_type").isNotNull(), F.max("lot_reserve") > 30_000, F.min("extent") >= 3, F.max("bank_id").isNotNull(), F.bool_or(F.col("possession") == "A")).alias("c"))
    filled = F.coalesce(F.size(F.filter("c", lambda x: x)), F.lit(0)).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id")).join(per, "listing_id", "left").select("listing_id", filled.alias("filled"), F.round(100 * filled / 5, 2).alias("pct"))


@query("WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS turns, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS growth FROM conversations) SELECT conv_id, turn, role, CAST(i AS INT) AS position, turns, growth, growth > 0 AS widened FROM t")
def conversation_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    growth = F.length("text") - F.lag(F.length("text")).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("position"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"), growth.cast("long").alias("growth"), (growth > 0).alias("widened"))


@query("WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS scope FROM conversations) SELECT conv_id, turn, last_value(scope IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM t")
def conversation_scope(spark, sf_dir):
    """What a thread last asked for carries over to its later turns."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("scope"))
