"""Source divergence audit by inclusion-exclusion over supports (operator 13).

Every (lang, source) group gives each of its language's V kept terms a price
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)); a term that a group lacks has the
group's zero price z. The distance of two groups is the sum of abs(p - q) over
all V terms, found without going through them:

1. *One-sided.* A histogram of each group's counts prices its whole support
   against the other's zero price. Running sums over the histogram, with the
   other groups' zero prices sorted in among it, give all partners at once.
2. *Overlaps.* Groups that share a term meet in a join of postings, which puts
   the term's true difference in place of its two one-sided ones.
3. *Both zero.* The terms that neither has, V less both supports plus the
   overlap, cost the constant abs(z - z') each.

Counts come from one pass over the texts: tasks count the terms of a slice of
texts by group, with bytes compared, and Spark sums them before and after the
shuffle. The documents that hold a term are counted in the same pass, as a
document belongs to one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small, stored, text_batches
from .textkit import keep_nothing, lower_ascii, text_slices

#: A term is kept if so many documents of its language hold it.
KEPT_FROM = 30
#: Ranks of terms that a group reports.
TERM_RANKS = 50
#: Added to every count.
SMOOTHING = 5
#: Texts that are counted together; more make fewer partial counts.
SLICE_BYTES = 8 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all rows, ASCII letters lower-cased, and the row of each."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    first = inside & ~(before & ~edge[:-1])
    packed = lower_ascii(data[inside])
    starts = np.flatnonzero(first[inside])  # in the packed bytes
    ends = np.append(starts, len(packed)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed)))
    return terms.dictionary_encode(), np.searchsorted(offsets, np.flatnonzero(first), "right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of every group and term, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for at, _, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                terms, row = text_terms(data, offsets)
                size = max(1, len(terms.dictionary))
                held, times = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
                key, index = np.unique(group[at + held // size] * size + held % size, return_inverse=True)
                of, term = key // size, key % size
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // len(source.dictionary))),
                        source.dictionary.take(pa.array(of % len(source.dictionary))),
                        terms.dictionary.take(pa.array(term)).cast(pa.string()),
                        pa.array(np.bincount(index, times, len(key)).astype(np.int64)),
                        pa.array(np.bincount(index, minlength=len(key)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    parts = text_batches(docs.select("lang", "source", "text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def price(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * kept)), by long division in three steps of 1000, so that no count overflows."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    base = total + SMOOTHING * kept
    rest, out = n + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, base)
        rest = (rest * 1000) % base
    return F.when(base > 0, 1 + out)


def one_sided(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item, value: the prices of the source's terms summed as differences from the item's zero price."""
    steps = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    own = steps.select("lang", "source", F.lit(None).cast("string").alias("item"), "p", "terms")
    asked = groups.where("kept > 0").select("lang", "source").join(groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("p")), "lang").where("source != item")
    both = own.unionByName(asked.select("lang", "source", "item", "p", F.lit(0).cast("long").alias("terms")))
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("p", F.col("item").asc_nulls_last())  # equal prices differ by 0 on either side
    amount = F.col("terms") * F.col("p")
    sums = {"k": F.sum("terms").over(below), "t": F.sum(amount).over(below), "all_k": F.sum("terms").over(group), "all_t": F.sum(amount).over(group)}
    return both.select("*", *(c.alias(k) for k, c in sums.items())).where("item IS NOT NULL").select("lang", "source", "item", F.expr("(all_t - t) - (all_k - k) * p + k * p - t").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Part ``pair``: every other source of the language and the distance of both,
    summed over all kept terms; 0 where the language keeps none. Part ``term``:
    the TERM_RANKS terms that the source holds beyond the language's price, and
    by how much. Ranks go by falling value, then item by its bytes.

    A null text, lang or source is the empty string; a text without terms makes
    its group all the same; repeated rows count as often as they come; long
    texts are counted whole; an empty table gives no rows. doc_id and other
    columns are ignored, whatever their names. Terms are told apart by their
    bytes, and all sums are of whole numbers.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(docs)
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= KEPT_FROM).drop("docs")
    postings = stored(counts.join(held, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")

    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    langs = stored(postings.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "langs")
    named = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(small(langs), "lang", "left")
    named = named.na.fill(0, ["total", "support", "kept", "lang_total"])
    groups = stored(named.withColumn("zero", price(F.lit(0), "total", "kept")), "groups")
    near = small(groups)
    priced = stored(postings.join(near, ["lang", "source"]).select("lang", "source", "term", price("n", "total", "kept").alias("p"), price("lang_n", "lang_total", "kept").alias("q"), "zero"), "priced")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(best)
    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", ranked).where(F.col("rank") <= TERM_RANKS)

    left, right = (priced.select("lang", "term", *(F.col(c).alias(f"{c}_{k}") for c in ("source", "p", "zero"))) for k in "ab")
    mend = F.expr("abs(p_a - p_b) - abs(p_a - zero_b) - abs(p_b - zero_a)")
    met = left.join(right, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(mend).alias("mend"), F.count("*").alias("common"))
    met = stored(met, "overlaps").toDF("lang", "source", "item", "mend", "common")
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "mend", "common"))
    one = stored(one_sided(near, priced), "one-sided")
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("value").alias("back"))
    mine = groups.select("lang", "source", "support", "kept", "zero")
    theirs = near.select("lang", F.col("source").alias("item"), F.col("support").alias("their_support"), F.col("zero").alias("their_zero"))
    pairs = mine.join(theirs, "lang").where("source != item")
    for more in (one, back, met):
        pairs = pairs.join(more, ["lang", "source", "item"], "left")
    neither = F.expr("kept - support - their_support + coalesce(common, 0)") * F.abs(F.col("zero") - F.col("their_zero"))
    value = F.coalesce(F.col("value") + F.col("back") + F.coalesce("mend", F.lit(0)) + neither, F.lit(0))
    apart = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return apart.withColumn("rank", ranked).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30
), n AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1
), full_n AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM full_n JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY 1, 2) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
