"""Whether links may be written: contradictions that they would make, and a reproducible sample of them to look at."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linkage import components


def problems(pairs: DataFrame, rows: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(problem, a, b) of what speaks against writing ``pairs`` (a, b, confidence); no rows where it is safe.

    ``rows`` has id, source, price and unit (null where unknown). Confirmed
    pairs merge listings; ``prices_differ`` and ``units_differ`` name the
    smallest and largest id of a source's listings that would be one but
    contradict each other, ``already_merged`` pending pairs whose ends the
    confirmed ones merge, ``confirmed_and_pending`` a pair that is both.
    """
    confirmed, pending = (store(pairs.where(F.col("confidence") == c).select("a", "b").distinct()) for c in ("CONFIRMED", "PENDING"))
    member = components(confirmed, store)
    held = rows.join(member, "id").groupBy("component", "source").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct(F.round("price")).alias("prices"), F.count_distinct("unit").alias("units"), F.count("*").alias("n")
    )
    several = held.where("n > 1")
    clash = several.where("prices > 1").select(F.lit("prices_differ").alias("problem"), "a", "b").unionByName(several.where("prices <= 1 AND units > 1").select(F.lit("units_differ").alias("problem"), "a", "b"))
    ends = pending.join(member.toDF("a", "_ca"), "a").join(member.toDF("b", "_cb"), "b").where("_ca = _cb")
    both = pending.join(confirmed, ["a", "b"], "left_semi")
    merged = ends.join(both, ["a", "b"], "left_anti")
    return clash.unionByName(merged.select(F.lit("already_merged").alias("problem"), "a", "b")).unionByName(both.select(F.lit("confirmed_and_pending").alias("problem"), "a", "b"))


def spot_sample(pairs: DataFrame, decided: DataFrame, day: str, size: int) -> DataFrame:
    """(a, source) of up to ``size`` confirmed cases that nobody has decided, the same for the same day: the smallest by a hash with the day."""
    cases = pairs.where("confidence = 'CONFIRMED'").select("a", "source").distinct().join(decided.select("a", "source"), ["a", "source"], "left_anti")
    order = F.sha2(F.concat_ws("|", F.lit(day), F.col("a").cast("string"), "source"), 256)
    return cases.orderBy(order, "a", "source").limit(size)


def canonical_columns(rows: DataFrame, links: DataFrame, photos: DataFrame) -> DataFrame:
    """``rows`` (id, source) with also_on, other_listings and photos: the other portals of each listing, its bridged copies, and its photos with the main one first.

    ``links``: a, b, confidence, method, either way round; only confirmed and
    probable ones count. ``photos``: id, position, url, public_url, is_main;
    those without an address are left out.
    """
    some = links.where(F.col("confidence").isin("CONFIRMED", "PROBABLE"))
    both = some.select(F.col("a").alias("id"), F.col("b").alias("other"), "method").unionByName(some.select(F.col("b").alias("id"), F.col("a").alias("other"), "method"))
    named = both.join(rows.select(F.col("id").alias("other"), F.col("source").alias("_on")), "other").withColumn("_best", F.row_number().over(Window.partitionBy("id", "other").orderBy("method"))).where("_best = 1")
    copies = named.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("_on")), ",").alias("also_on"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "method"))), lambda o: F.concat_ws(":", o["other"].cast("string"), o["method"])), ",").alias("other_listings"))
    shown = photos.withColumn("_url", F.coalesce("public_url", "url")).where("_url IS NOT NULL")
    seen = F.transform(F.array_sort(F.collect_list(F.struct((~F.coalesce("is_main", F.lit(False))).alias("later"), "position", "_url"))), lambda p: p["_url"])
    pictures = shown.groupBy("id").agg(F.array_join(seen, " ").alias("photos"))
    out = rows.join(copies, "id", "left").join(pictures, "id", "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("also_on", "other_listings", "photos")))
