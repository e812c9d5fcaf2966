"""Benchmarks, sale chains, scores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def benchmark_rings(subjects: DataFrame, peers: DataFrame, rings: dict[str, list[str]], least: int = 5) -> DataFrame:
    """Percentiles of the peers' unit price in rings that widen, and each subject's place in them.

    ``subjects`` and ``peers`` have key, unit_price and the ring columns. Rings
    are taken side by side, each by its own columns; those with fewer than
    ``least`` peers give no row. Peers are counted once for each price of a ring
    and kinds of subjects, which agree in all columns, joined by ring and price;
    subjects meet what all rings say of their kind once, so a ring costs no pass
    over them and all peers can be subjects. Prices of a ring are dealt over tasks by range,
    so that a ring that all lots share is no one task's, and its quantiles are
    read off the ranks. A null price is below nothing. Both tables are read for
    each ring, so they are stored first.
    """
    columns = list(dict.fromkeys(c for by in rings.values() for c in by)) + ["unit_price"]
    same = subjects is peers
    subjects = stored(subjects.select("key", *columns), "ring-subjects")
    # rows that agree in all columns have the same place in every ring
    kinds = stored(subjects.groupBy(*columns).agg(F.count("*").alias("_rows")).withColumn("_kind", F.monotonically_increasing_id()), "ring-kinds")
    peers = kinds if same else stored(peers.select(*columns), "ring-peers")
    out = None
    for name, by in rings.items():
        both = peers.select(*by, "unit_price", (F.col("_rows") if same else F.lit(1)).alias("_n"))
        if not same:  # subjects' own prices are among the prices, with no peer of theirs
            both = both.unionByName(kinds.select(*by, "unit_price", F.lit(0).alias("_n")))
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by))  # a null ring is no ring
        prices = both.where(known).groupBy(F.struct(*by).alias("_ring"), "unit_price").agg(F.sum("_n").alias("_n"))
        ranked = stored(counted_before(prices.where("unit_price IS NOT NULL"), "_ring", ["unit_price"], "_n"), "ring-prices")
        # a quantile lies between the prices at two ranks, each the price whose peers cover the rank
        cuts = {"p25": 0.25, "median": 0.5, "p75": 0.75}
        at = {c: q * (F.col("_total") - 1) for c, q in cuts.items()}
        held = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("unit_price")))
        ends = ranked.where("_n > 0").groupBy("_ring").agg(F.max("_total").alias("_total"), *[held(F.floor(r)).alias(f"{c}_low") for c, r in at.items()], *[held(F.ceil(r)).alias(f"{c}_high") for c, r in at.items()])
        whole = prices.groupBy("_ring").agg(F.sum("_n").alias("n")).where(F.col("n") >= least).join(ends, "_ring", "left")
        value = lambda c: F.round(F.col(f"{c}_low") + (at[c] - F.floor(at[c])) * (F.col(f"{c}_high") - F.col(f"{c}_low")), 9)
        placed = whole.select(F.col("_ring").alias("_of"), "n", *[value(c).alias(c) for c in cuts])
        own = kinds.select("_kind", F.struct(*by).alias("_mine"), F.col("unit_price").alias("_own")).where(known)
        one = own.join(placed, F.col("_mine") == F.col("_of")).join(ranked.select("_ring", "unit_price", "_before"), (F.col("_mine") == F.col("_ring")) & (F.col("_own") == F.col("unit_price")), "left")
        below = F.coalesce("_before", F.lit(0))
        one = one.select("_kind", F.lit(name).alias("ring"), "n", *cuts, below.alias("below"), F.round(100 * below / F.col("n"), 2).alias("percent_below"))
        out = one if out is None else out.unionByName(one)
    said = ["ring", "n", *cuts, "below", "percent_below"]
    found = out.groupBy("_kind").agg(F.collect_list(F.struct(*said)).alias("_said"))
    placed = kinds.join(found, "_kind").select(*[F.col(c).alias(f"_{c}") for c in columns], "_said")
    alike = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return subjects.join(placed, alike).select("key", F.inline("_said"))


def refusal(reserve: str, lot_count: str, resolved: str, extent: str, band: tuple[float, float]) -> Column:
    """The first reason why a listing can't be benchmarked, null if it can."""
    return (
        F.when(F.col(reserve).isNull(), "no_reserve")
        .when(F.coalesce(F.col(lot_count), F.lit(0)) == 0, "no_lots")
        .when((F.col(lot_count) > 1) & ~F.col(resolved), "several_lots")
        .when(F.col(extent).isNull() | ~F.col(extent).between(*band), "no_extent")
    )


def attempt_chain(rows: DataFrame, by: str, when: str, key: str, price: str) -> DataFrame:
    """Attempts 1..n of each chain in date order (no date last, ties by id), with the one before and the chain's size."""
    order = Window.partitionBy(by).orderBy(F.col(when).asc_nulls_last(), key)
    whole = Window.partitionBy(by)
    return rows.select(
        key, by, F.row_number().over(order).alias("attempt_no"), F.count("*").over(whole).alias("chain_size"), F.lag(price).over(order).alias("previous_price"), F.lag(key).over(order).alias("previous_id")
    )


def distinct_day_rank(rows: DataFrame, by: str, when: str, key: str) -> DataFrame:
    """Rounds by distinct day; every round before the last was unsold."""
    order = Window.partitionBy(by).orderBy(F.to_date(when))
    ranked = rows.select(key, by, F.dense_rank().over(order).alias("round"))
    return ranked.withColumn("outcome", F.when(F.col("round") < F.max("round").over(Window.partitionBy(by)), "unsold"))


def previous_sale(rows: DataFrame, by: str, when: str, key: str, price: str) -> DataFrame:
    """Highest price and number of strictly earlier sales of the same chain: a range frame, not a self-join."""
    stamp = F.unix_micros(F.col(when).cast("timestamp"))
    earlier = Window.partitionBy(by).orderBy(stamp).rangeBetween(Window.unboundedPreceding, -1)
    return rows.select(key, F.max(price).over(earlier).alias("previous_max"), F.count("*").over(earlier).alias("earlier"))


def agreement(stated: str, other: str, tolerance: float = 0.01, slips: tuple[int, ...] = (10, 100, 1000), slip_tolerance: float = 0.05) -> Column:
    """agree, magnitude_slip, disagree, or unknown where either is null or not above 0."""
    a, b = F.col(stated), F.col(other)
    high, low = F.greatest(a, b), F.least(a, b)
    slip = F.lit(False)
    for m in slips:
        slip = slip | (F.abs(high / low - m) <= slip_tolerance * m)
    return (
        F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0), "unknown").when(F.abs(a - b) <= tolerance * b, "agree").when(slip, "magnitude_slip").otherwise("disagree")
    )


def first_present(rows: DataFrame, by: str, rank: str, key: str, fields: list[str]) -> DataFrame:
    """Per field the value of the best-ranked row that has one, and which row that is. An empty text is absent."""

    def present(f: str) -> Column:
        c = F.col(f)
        return c.isNotNull() & (c.cast("string") != "")

    picks = [F.min(F.when(present(f), F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col(f).alias("v")))).alias(f) for f in fields]
    best = rows.groupBy(by).agg(*picks)
    return best.select(by, *[c for f in fields for c in (F.col(f"{f}.v").alias(f), F.col(f"{f}.k").alias(f"{f}_from"))])


def event_id(ids: Column) -> Column:
    """ev-<id> for one id, else ev- and the first 16 hex digits of the SHA-1 of the sorted ids joined by |."""
    joined = F.array_join(F.array_sort(ids), "|")
    return F.when(F.size(ids) == 1, F.concat(F.lit("ev-"), ids[0])).otherwise(F.concat(F.lit("ev-"), F.substring(F.sha1(joined), 1, 16)))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows pass the first i stages, for every i, in one pass."""
    passed, counts = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(name))
    wide = rows.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(stages)])).alias("v")).select("v.*")


def scorecard(rows: DataFrame, section: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(section, metric, value, total, pct) of conditions: how many rows meet the first among those that meet the second."""
    counts = [c for n, (hit, base) in metrics.items() for c in (F.count(F.when(hit & base, 1)).alias(f"{n}_v"), F.count(F.when(base, 1)).alias(f"{n}_t"))]
    wide = rows.agg(*counts)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_v").alias("value"), F.col(f"{n}_t").alias("total")) for n in metrics])).alias("v")
    return wide.select(long).select(F.lit(section).alias("section"), "v.*", F.round(100 * F.col("v.value") / F.nullif(F.col("v.total"), F.lit(0)), 2).alias("pct"))


def scorecard_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """Metrics of two snapshots side by side."""
    keys = ["section", "metric"]
    old = before.select(*keys, F.col("value").alias("before"))
    return now.select(*keys, F.col("value").alias("now")).join(old, keys, "full_outer").select(*keys, "now", "before", (F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("change"))


def deadline_alert(deadline: str, as_of: Column) -> tuple[Column, Column]:
    """(severity, whole days left): urgent within 1 day, soon within 3, upcoming within 7, else null."""
    hours = (F.unix_seconds(F.col(deadline).cast("timestamp")) - F.unix_seconds(as_of.cast("timestamp"))) / 3600
    severity = F.when(hours < 0, None).when(hours <= 24, "urgent").when(hours <= 72, "soon").when(hours <= 168, "upcoming")
    return severity, F.floor(hours / 24)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval; (0, 1) without trials."""
    p = hits / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def counted_before(rows: DataFrame, by: str, order: list[str], n: str | None = None) -> DataFrame:
    """``rows`` with _before, the sum of ``n`` (or the number) of the rows earlier in their group, and _total, that of the group.

    Rows are dealt over tasks by range of group and order and stored, so that a
    group of any size is split. Each range is summed on its own; what comes before
    a range is known from the sums of the ranges, one row a range and group.
    """
    ranged = rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id())
    held = stored(ranged, "ranged")
    size = F.lit(1) if n is None else F.col(n)
    here = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_range", F.col(by).alias("_by")).agg(F.sum(size).alias("_s"))
    group = Window.partitionBy("_by")
    sums = sums.select(F.col("_range").alias("_r"), "_by", F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_s").over(group).alias("_total"))
    inner = held.withColumn("_here", F.coalesce(F.sum(size).over(here), F.lit(0)))
    joined = inner.join(sums, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("_before", F.col("_here") + F.col("_offset")).drop("_range", "_r", "_by", "_here", "_offset")


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation by group; ties take their mean rank. Ranks come from the counts of each value, so a group is never one task's."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(by).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"))

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy("_g", c).agg(F.count("*").alias("_n"))
        # the mean of the ranks before + 1 to before + n
        return counted_before(counts, "_g", [c], "_n").select(F.col("_g").alias(f"_g{c}"), F.col(c).alias(f"_v{c}"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r{c}"))

    ranked = rows
    for c in ("_x", "_y"):
        ranked = ranked.join(ranks(c), F.col("_g").eqNullSafe(F.col(f"_g{c}")) & (F.col(c) == F.col(f"_v{c}")))
    return ranked.groupBy(F.col("_g").alias(by)).agg(F.count("*").alias("n"), F.round(F.corr("_r_x", "_r_y"), 4).alias("rho"))


def shared_groups(rows: DataFrame, group: str, member: str, per_task: int = 500_000) -> DataFrame:
    """Pairs of members and in how many groups both are: a, b, n with a < b.

    As pairs are many times the rows and hardly repeat before they are dealt, a
    task takes so many rows, whatever the size of the shuffled input says.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_task))
    x = rows.select(F.col(group).alias("g"), F.col(member).alias("a")).repartition(tasks, "g").distinct()
    pairs = x.join(x.withColumnRenamed("a", "b"), "g").where("a < b").select("a", "b")
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def majority(pairs: DataFrame, given: str, answer: str, support: int = 3, share: float = 0.9) -> DataFrame:
    """What a value nearly always goes with: answers with enough support and share."""
    counts = pairs.groupBy(given, answer).agg(F.count("*").alias("n"))
    whole = counts.withColumn("total", F.sum("n").over(Window.partitionBy(given)))
    return whole.where((F.col("n") >= support) & (F.col("n") >= share * F.col("total"))).select(given, answer, "n", "total")


def trend_halves(rows: DataFrame, by: str, when: str, key: str, value: str, flat: float = 0.15) -> DataFrame:
    """Mean of the first n // 2 rows against that of the rest, and whether it rose, fell or stayed."""
    placed = counted_before(rows.select(by, when, key, value), by, [when, key])
    first = F.col("_before") < F.floor(F.col("_total") / 2)
    out = placed.groupBy(by).agg(F.avg(F.when(first, F.col(value))).alias("a"), F.avg(F.when(~first, F.col(value))).alias("b"))
    change = F.col("b") - F.col("a")
    return out.select(by, F.round("a", 4).alias("first_half"), F.round("b", 4).alias("second_half"), F.when(change > flat, "up").when(change < -flat, "down").otherwise("flat").alias("trend"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """A reproducible draw that takes from the strata in turn; order comes from a hash of key and seed."""
    by = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("depth", F.row_number().over(by)).orderBy("depth", stratum).limit(n)


def prf(gold: DataFrame, found: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 over sets of (key, by)."""
    g, f = gold.select(*by, *key).distinct().withColumn("_g", F.lit(1)), found.select(*by, *key).distinct().withColumn("_f", F.lit(1))
    both = g.join(f, [*by, *key], "full_outer")
    counts = both.groupBy(*by).agg(F.count(F.when(F.col("_g").isNotNull() & F.col("_f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return counts.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def latest_states(moves: DataFrame, key: str, when: str, tie: str, allowed: dict[str, list[str]]) -> DataFrame:
    """The state of each key after its last allowed move. A move is allowed from the state before it in time."""
    order = Window.partitionBy(key).orderBy(when, tie)
    table = F.create_map(*(x for s, to in allowed.items() for x in (F.lit(s), F.array(*map(F.lit, to)))))
    before = F.lag("state").over(order)
    stepped = moves.withColumn("_before", before).withColumn("_ok", F.col("_before").isNull() | F.coalesce(F.array_contains(table[F.col("_before")], F.col("state")), F.lit(False)))
    return stepped.groupBy(key).agg(F.max(F.when(F.col("_ok"), F.struct(F.col(when).alias("w"), F.col(tie).alias("t"), F.col("state").alias("s")))).alias("m"), F.count(F.when(~F.col("_ok"), 1)).alias("refused")).select(key, F.col("m.s").alias("state"), F.col("m.w").alias("since"), "refused")


def fill_from_copies(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], key: str) -> DataFrame:
    """One row a group, the first by ``order``, whose null fields take the first value that a copy has."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = rows.select(*by, key, *[F.first(f, ignorenulls=True).over(whole).alias(f) for f in fields], F.count("*").over(Window.partitionBy(*by)).alias("copies"), F.row_number().over(w).alias("_i"))
    return filled.where("_i = 1").drop("_i")
