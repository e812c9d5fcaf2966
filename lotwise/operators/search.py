"""Faceted search: one list of labelled conditions that every count, page and diagnosis shares."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a page at most, and of a break-down.
PAGE_MOST, BREAKDOWN_MOST = 50, 40


@dataclass(frozen=True)
class Filters:
    """Conditions by label; those in ``standing`` can't be dropped."""

    conditions: dict[str, Column] = field(default_factory=dict)
    standing: frozenset[str] = frozenset()

    def add(self, label: str, condition: Column | None) -> Filters:
        """With one more condition; None (an option not given) adds nothing."""
        return self if condition is None else Filters(self.conditions | {label: condition}, self.standing)

    def keep(self, label: str, condition: Column) -> Filters:
        return Filters(self.conditions | {label: condition}, self.standing | {label})

    def without(self, *labels: str) -> Filters:
        dropped = set(labels) - self.standing
        return Filters({k: v for k, v in self.conditions.items() if k not in dropped}, self.standing)

    @property
    def droppable(self) -> list[str]:
        return [k for k in self.conditions if k not in self.standing]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions.values(), F.lit(True))

    def on(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.column())


def same_text(column: str, value: str | None) -> Column | None:
    return None if value is None else F.lower(F.col(column)) == value.lower()


def has_text(column: str, value: str | None) -> Column | None:
    """Substring without regard to case; the value is taken literally, not as a pattern."""
    return None if value is None else F.lower(F.col(column)).contains(value.lower())


def any_of(column: str, values: Iterable | None) -> Column | None:
    return None if not values else F.col(column).isin(list(values))


def between(column: str, low, high) -> Column | None:
    """A range with either end open; a low end above the high one is an error."""
    if low is None and high is None:
        return None
    if low is not None and high is not None and low > high:
        raise ValueError(f"{column}: {low} is above {high}")
    c = F.col(column)
    return (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))


def page_size(limit: int | None, most: int = PAGE_MOST) -> int:
    return max(1, min(most, limit or most))


def stats(rows: DataFrame, price: str = "reserve", when: str = "auction_dt") -> DataFrame:
    """Exact count and price and date aggregates in one pass."""
    p = F.col(price)
    return rows.agg(
        F.count("*").alias("total"),
        F.count(p).alias("priced"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        F.round(F.avg(p), 2).alias("avg_price"),
        F.min(when).alias("first_dt"),
        F.max(when).alias("last_dt"),
    )


def quantiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, p25, median, p75, max of a value, exact, by group."""
    p = [F.round(F.percentile(value, F.lit(q)), 4).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.min(value).alias("low"), *p, F.max(value).alias("high"))


def price_band(price: str, edges: list[float]) -> Column:
    """Names of price bands by upper edge; 'unknown' for null."""
    out = F.when(F.col(price).isNull(), "unknown")
    low = 0
    for high in edges:
        out = out.when(F.col(price) < high, f"{low:g}-{high:g}")
        low = high
    return out.otherwise(f"{low:g}+")


def month(when: str) -> Column:
    return F.date_format(when, "yyyy-MM")


def breakdown(rows: DataFrame, dimension: Column, key: str, most: int | None = BREAKDOWN_MOST) -> DataFrame:
    """Distinct listings for each value that isn't null, most frequent first, ties by value."""
    counted = rows.select(dimension.cast("string").alias("value"), key).where("value IS NOT NULL").groupBy("value").agg(F.countDistinct(key).alias("n")).orderBy(F.desc("n"), "value")
    return counted if most is None else counted.limit(most)


def value_counts(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) of every value that isn't null, by one pass over the rows."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()])).alias("v")).select("v.*")
    return stacked.where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, dimensions: dict[str, Column], k: int) -> DataFrame:
    """The k most frequent values of each dimension, by one pass over the rows."""
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return value_counts(rows, dimensions).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def facets(rows: DataFrame, filters: Filters, dimensions: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """Counts of each dimension's values, each without its own filter and those that depend on it.

    One pass: a row counts for a dimension if it meets all other conditions.
    """
    parts = []
    for name, (value, own) in dimensions.items():
        parts.append(F.when(filters.without(*own).column(), F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))))
    stacked = rows.select(F.explode(F.array(*parts)).alias("v")).where("v IS NOT NULL AND v.value IS NOT NULL").select("v.*")
    return stacked.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def relax(rows: DataFrame, filters: Filters) -> DataFrame:
    """How many rows there would be without each droppable filter, where more than none; needs two of them."""
    labels = filters.droppable if len(filters.droppable) >= 2 else []
    counts = [F.count(F.when(filters.without(x).column(), 1)).alias(x) for x in labels]
    if not counts:
        return rows.sparkSession.createDataFrame([], "dropped string, n long")
    wide = rows.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("dropped"), F.col(x).alias("n")) for x in labels])).alias("v")).select("v.*").where("n > 0")


def sort_columns(name: str) -> list[Column]:
    """The named sorts; a null comes last and the id breaks ties. Names with a direction take any of their columns either way."""
    either = {"deadline": "deadline", "start": "auction_dt", "price": "reserve", "emd": "emd"}
    sorts = {
        "deadline": [F.col("deadline").asc_nulls_last()],
        "auction_date": [F.col("auction_dt").asc_nulls_last()],
        "recent": [F.col("auction_dt").desc_nulls_last()],
        "area_desc": [F.col("area").desc_nulls_last()],
    } | {f"{n}_{way}": [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last()] for n, c in either.items() for way in ("asc", "desc")}
    return [*sorts[name], F.col("listing_id").asc()]


def pages(rows: DataFrame, sorts: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each named sort: sort, position, listing_id."""
    out = None
    for name in sorts:
        top = rows.orderBy(*sort_columns(name)).limit(size)
        one = top.select(F.lit(name).alias("sort"), F.row_number().over(Window.orderBy(*sort_columns(name))).alias("position"), "listing_id")  # of ``size`` rows
        out = one if out is None else out.unionByName(one)
    return out


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows, each with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(total), how="inner")


def any_contains(columns: list[str], words: list[str]) -> Column:
    """Whether any of the columns holds any of the words, in any case."""
    out = F.lit(False)
    for c in columns:
        for w in words:
            out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(w.lower())), F.lit(False))
    return out


def whole_match(column: str, pattern: str) -> Column:
    """Whether the pattern fits the whole value, in any case."""
    return F.col(column).rlike(f"(?i)^(?:{pattern})$")


def end_of_day(day: Column) -> Column:
    """A date as the upper end of a range: its last second. A time of day stays."""
    at = day.cast("timestamp_ntz")
    return F.when(at == F.date_trunc("day", at).cast("timestamp_ntz"), F.timestamp_add("SECOND", F.lit(86399), at)).otherwise(at)


# What a wider property type stands for.
TYPE_SYNONYMS = {"building": ["BUILDING", "HOUSEHOLD"], "vehicle": ["AUTOMOBILE", "MACHINERY"]}


def typed(column: str, wanted: list[str]) -> Column:
    """Rows of any wanted type, wider ones expanded."""
    return F.col(column).isin(sorted({x for w in wanted for x in TYPE_SYNONYMS.get(w.lower(), [w])}))


def auction_filters(**asked: object) -> Filters:
    """The filters of a listing search by name; a filter that isn't asked for, or is None, doesn't exist.

    state, city, category, status, borrower, text: equal or contained text;
    types: wider types; price_least, price_most, area_least, area_most, from_day,
    to_day (a day counts whole), sources (ranks), ids, past (True or False, with
    as_of), priced, dated.
    """
    day = lambda k: F.lit(asked[k]).cast("timestamp_ntz")
    known = {
        "state": lambda v: same_text("state", v),
        "city": lambda v: same_text("city", v),
        "category": lambda v: has_text("category", v),
        "types": lambda v: typed("category", v),
        "status": lambda v: any_of("status", v),
        "borrower": lambda v: has_text("borrower", v),
        "text": lambda v: any_contains(["city", "state", "category", "borrower"], [v]),
        "price_least": lambda v: F.col("reserve") >= v,
        "price_most": lambda v: F.col("reserve") <= v,
        "area_least": lambda v: F.col("area") >= v,
        "area_most": lambda v: F.col("area") <= v,
        "from_day": lambda v: F.col("auction_dt") >= day("from_day"),
        "to_day": lambda v: F.col("auction_dt") <= end_of_day(day("to_day")),
        "sources": lambda v: any_of("source_rank", v),
        "ids": lambda v: any_of("listing_id", v),
        "priced": lambda v: F.col("reserve").isNotNull() if v else F.col("reserve").isNull(),
        "dated": lambda v: F.col("auction_dt").isNotNull() if v else F.col("auction_dt").isNull(),
    }
    strange = set(asked) - set(known)
    if strange:
        raise ValueError(f"no such filters: {sorted(strange)}")
    for low, high in (("price_least", "price_most"), ("area_least", "area_most"), ("from_day", "to_day")):
        if asked.get(low) is not None and asked.get(high) is not None and asked[low] > asked[high]:
            raise ValueError(f"{low} is above {high}")
    out = Filters()
    for name, condition in known.items():
        if asked.get(name) is not None:
            out = out.add(name, condition(asked[name]))
    return out


def zero_hint(filters: int, relaxed: DataFrame) -> DataFrame:
    """One row (hint): which filter to drop, where none matches; else that nothing does."""
    best = relaxed.agg(F.max_by(F.struct("dropped", "n"), F.struct(F.col("n"), F.col("dropped"))).alias("b"))
    said = F.concat(F.lit(f"none matches all {filters} filters; without "), F.col("b.dropped"), F.lit(" there are "), F.col("b.n").cast("string"))
    return best.select(F.coalesce(said, F.lit("nothing matches")).alias("hint"))


def found(rows: DataFrame, filters: Filters, narrow: dict[str, Column], size: int = 10, group_by: Column | None = None) -> DataFrame:
    """One answer to a search, as (section, position, label, n).

    ``total`` and ``priced`` counts; a ``group`` break-down instead of rows if
    asked for; else ``row`` (its id) in the order of price_desc, and ``refine``
    values of ``narrow`` if there are more rows than shown; with no row ``relax``
    counts and a ``hint``. The total is the only number that decides, and the
    only one that comes to the driver.
    """
    hit = filters.on(rows)
    total = hit.count()
    line = lambda df, section, label, n, order: df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("int").alias("position"), label.cast("string").alias("label"), n.cast("long").alias("n"))
    stats_ = hit.agg(F.count("*").alias("t"), F.count("reserve").alias("p")).select(F.explode(F.array(F.struct(F.lit("total").alias("l"), F.col("t").alias("n")), F.struct(F.lit("priced").alias("l"), F.col("p").alias("n")))).alias("v")).select("v.*")
    out = line(stats_, "stats", F.col("l"), F.col("n"), [F.desc("l")])
    if group_by is not None:
        return out.unionByName(line(breakdown(hit, group_by, "listing_id"), "group", F.col("value"), F.col("n"), [F.desc("n"), F.col("value")]))
    if not total:
        easier = relax(rows, filters)
        return out.unionByName(line(easier, "relax", F.col("dropped"), F.col("n"), [F.desc("n"), F.col("dropped")])).unionByName(line(zero_hint(len(filters.conditions), easier), "hint", F.col("hint"), F.lit(None), [F.col("hint")]))
    top = hit.orderBy(*sort_columns("price_desc")).limit(size)
    out = out.unionByName(line(top, "row", F.col("listing_id"), F.lit(None), sort_columns("price_desc")))
    if total > size:
        out = out.unionByName(line(top_values(hit, narrow, 3), "refine", F.concat_ws(":", "dimension", "value"), F.col("n"), [F.col("dimension"), F.desc("n"), F.col("value")]))
    return out


def upcoming_first(rows: DataFrame, when: str, key: str, as_of: Column) -> list[Column]:
    """Future dates in order, then past ones backwards, then those without a date."""
    group = F.when(F.col(when).isNull(), 2).when(F.col(when) >= as_of, 0).otherwise(1)
    return [group.asc(), F.when(F.col(when) >= as_of, F.col(when)).asc_nulls_last(), F.col(when).desc_nulls_last(), F.col(key).asc()]


def lookup(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows by id in the caller's order; an id that isn't there has found = false. The id list is a bounded argument."""
    asked = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} {dict(rows.dtypes)[key]}")
    return F.broadcast(asked).join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def canonical(rows: DataFrame, neighbours: DataFrame, key: str = "listing_id", rank: str = "source_rank", default: int = 3) -> DataFrame:
    """Drop a row if a direct neighbour has a lower source rank, ties by lower id. neighbours: (key, other)."""
    ranked = rows.select(F.col(key).alias("_o"), F.coalesce(rank, F.lit(default)).alias("_orank"))
    own = rows.select(key, F.coalesce(rank, F.lit(default)).alias("_rank"))
    beaten = neighbours.join(own, key).join(ranked, F.col("other") == F.col("_o")).where((F.col("_orank") < F.col("_rank")) | ((F.col("_orank") == F.col("_rank")) & (F.col("_o") < F.col(key)))).select(key).distinct()
    return rows.join(beaten, key, "left_anti")


def lot_scope(lots: DataFrame, resolved: DataFrame) -> DataFrame:
    """(listing_id, lot_no, lot_count, scope): the lots that a listing is tested against.

    That is the resolved lot if there is one, else every lot of the notice;
    lot_count is always that of the notice. scope: lot if resolved or single.
    """
    counts = lots.groupBy("listing_id").agg(F.countDistinct("lot_no").alias("lot_count"))
    own = resolved.select("listing_id", F.col("lot_no").alias("own_lot"))
    out = lots.join(own, "listing_id", "left").where("own_lot IS NULL OR own_lot = lot_no").join(counts, "listing_id")
    return out.select("listing_id", "lot_no", "lot_count", F.when(F.col("own_lot").isNotNull() | (F.col("lot_count") == 1), "lot").otherwise("notice").alias("scope"))
