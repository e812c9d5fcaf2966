"""Line dedup by distributed prefix doubling over line-ID sequences (operator 7).

All documents in order of doc_id are one sequence of line IDs, in which no run
crosses a document's end. Prefix doubling names the suffixes by their first
1, 2, 4, .. lines: the name of a class is the least position in it, that is the
head of its LCP interval, and a suffix that shares its lines with no other
drops out, so that a round handles repeated lines only. The suffixes that
share their first ``l`` lines, 2**k <= l < 2**(k + 1), are those with the same
names at ``p`` and ``p + l - 2**k`` in round ``k``.

Lines are told apart by two independent 64-bit hashes of their bytes.

A repeated run counts from ``min_words`` words on. Every such run is the union of
its shortest sub-runs of that many words (from each line on, and up to each
line), and equal runs have equal shortest sub-runs, so the maximal repeated
runs are exactly the unions of repeated shortest runs. Those at other than
their first position are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, small, stored, text_batches
from .textkit import keep_nothing, span_hashes, text_slices, word_spans

#: Words that a repeated run has at least, if the caller doesn't say.
MIN_WORDS = 50

_LAST = (1 << 63) - 1


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the shortest runs with ``least`` words, from each line on and up to each line."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    first = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)  # least end with enough words
    on = end <= n
    last = np.arange(1, n + 1)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1  # largest begin with enough words
    up = begin >= 0
    # a run neither begins nor ends with lines without words that it could do without
    pairs = np.unique(np.stack((np.concatenate((first[on], begin[up])), np.concatenate((end[on], last[up]))), 1), axis=0)
    return pairs[:, 0], pairs[:, 1] - pairs[:, 0]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, version (a hash of the text), ids and checks (two hashes) of the lines, and their shortest runs, for each row with text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(2)):
                breaks = np.flatnonzero(data == 10)
                starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
                ends = np.sort(np.concatenate((breaks, offsets[1:])))
                ids, checks = (span_hashes(data, starts, ends, lane).view(np.int64) for lane in (0, 1))
                begin = np.concatenate(([0], np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1)))
                word_starts = word_spans(data, offsets)[0]
                words = np.diff(np.searchsorted(word_starts, np.append(starts, len(data) + 1)))
                firsts, sizes, count = [], [], [0]
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    f, n = shortest_runs(words[a:b], min_words)
                    firsts.append(f)
                    sizes.append(n)
                    count.append(count[-1] + len(f))

                def lists(values: np.ndarray, places: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.asarray(places, np.int32)), pa.array(values))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), lists(ids, begin), lists(checks, begin), lists(np.concatenate(firsts).astype(np.int32), count), lists(np.concatenate(sizes).astype(np.int32), count)],
                    names=["doc", "version", "ids", "checks", "run_first", "run_lines"],
                )

    keyed = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    return text_batches(keyed).mapInArrow(cut, "doc long, version long, ids array<long>, checks array<long>, run_first array<int>, run_lines array<int>")


def with_positions(lines: DataFrame) -> DataFrame:
    """Number all lines in order of (doc, version); rows that repeat both are one document. Adds start, the number of its first line."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        before = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            keep, start = [], []
            for i, (key, n) in enumerate(zip(keys, sizes.tolist(), strict=True)):
                if key != before:
                    keep.append(i)
                    start.append(at)
                    at += n
                    before = key
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(start, pa.int64())], names=[*batch.schema.names, "start"])

    schema = "doc long, version long, ids array<long>, checks array<long>, run_first array<int>, run_lines array<int>, start long"
    lines = stored(lines, "line-lists")  # range partitioning reads its input twice
    return stored(lines.repartitionByRange("doc", "version").sortWithinPartitions("doc", "version").mapInArrow(number, schema), "lines")


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` whose keys are shared by several positions ``p``, with the least of these as ``name``.

    Counts are pre-aggregated and stored, so a frequent key is a join of two
    scans whose large side AQE can split.
    """
    shared = stored(rows.groupBy(*keys).agg(F.min("p").alias(name), F.count("*").alias("times")).where("times > 1").drop("times"), "names")
    return rows.join(shared, keys)


def repeated_runs(lines: DataFrame) -> DataFrame:
    """start (of the document), p (first line) and n (lines) of every shortest run that stands earlier too."""
    place = lines.select("start", (F.col("start") + F.size("ids")).alias("end"), F.posexplode(F.arrays_zip("ids", "checks")).alias("line", "at")).select("start", "end", (F.col("start") + F.col("line")).alias("p"), "at.ids", "at.checks")
    names = stored(_named(stored(place, "places"), ["ids", "checks"], "name").select("p", "end", "name"), "round")
    runs = lines.select("start", F.explode(F.arrays_zip("run_first", "run_lines")).alias("r")).select("start", (F.col("start") + F.col("r.run_first")).alias("p"), F.col("r.run_lines").alias("n"))
    runs = stored(runs, "runs")
    one = runs.where("n = 1").join(names, "p").where("name < p").select("start", "p", "n")
    found, left, k = stored(one, "found"), runs.where("n > 1"), 1
    while True:
        # only runs whose first and last 2**(k - 1) lines are repeated can be
        half = 1 << (k - 1)
        left = stored(left.join(names.select("p"), "p", "left_semi").withColumn("q", F.col("p") + F.col("n") - half).join(names.select(F.col("p").alias("q")), "q", "left_semi").select("start", "p", "n"), "left")
        if left.isEmpty():
            return found
        a, b = names.alias("a"), names.select((F.col("p") - half).alias("p"), F.col("name").alias("then"))
        pairs = stored(a.join(b, "p").where(F.col("p") + 2 * half <= F.col("end")).select("p", "end", "name", "then"), "pairs")
        names = stored(_named(pairs, ["name", "then"], "head").select("p", "end", F.col("head").alias("name")), "round")
        size, width = 2 * half, 4 * half
        due = left.where(F.col("n") < width)
        heads = names.select("p", F.col("name").alias("head"))
        tails = names.select(F.col("p").alias("q"), F.col("name").alias("tail"))
        known = stored(due.join(heads, "p").withColumn("q", F.col("p") + F.col("n") - size).join(tails, "q").select("start", "p", "n", "head", "tail"), "known")
        later = _named(known, ["n", "head", "tail"], "least").where("least < p").select("start", "p", "n")
        found, left, k = stored(found.unionByName(later), "found"), left.where(F.col("n") >= width), k + 1


def _unused(name: str, columns: list[str]) -> str:
    """The name, made longer until no column has it."""
    held = {c.lower() for c in columns}
    while name in held:
        name += "_"
    return name


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of repeated line runs of ``min_words`` words or more; shorter ones stay.

    Returns the columns of ``docs`` (at least doc_id and text) with the text
    left over, and then line_count, lines_removed and removed: the deleted runs
    as (first line, lines), from 0. A null text stays null (line_count 0), an
    empty one is a single empty line. The copy that stays is the one in the
    smallest doc_id, and there the first; a null doc_id comes last. Rows that
    repeat doc_id and text are one document and treated alike; those with the
    same doc_id and other texts are in order of a hash of the text. Texts of any
    length are cut whole; an empty table gives no rows. Columns of
    ``docs`` named like the added ones are dropped.
    """
    spark = docs.sparkSession
    added = ["line_count", "lines_removed", "removed"]
    docs = docs.drop(*added)
    at_doc, at_version, at_spans = (_unused(n, docs.columns) for n in ("_doc", "_version", "_spans"))
    lines = with_positions(line_table(docs, min_words))
    runs = repeated_runs(lines).groupBy("start").agg(F.collect_list(F.struct(F.col("p").alias("p"), F.col("n").alias("n"))).alias("spans"))
    marked = runs.join(lines.select("doc", "version", "start"), "start").select(F.col("doc").alias(at_doc), F.col("version").alias(at_version), F.transform("spans", lambda s: F.struct((s["p"] - F.col("start")).cast("int").alias("first"), s["n"].cast("int").alias("lines"))).alias(at_spans))
    marked = small(stored(marked, "marked"), F.size(at_spans))
    release(spark)
    keyed = docs.withColumns({at_doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), at_version: F.xxhash64("text")})
    joined = keyed.join(marked, [at_doc, at_version], "left").select(*docs.columns, at_spans)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", line_count int, lines_removed int, removed array<struct<first: int, lines: int>>"
    at_text, spans_type = docs.columns.index("text"), pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, _, _ in text_slices(batch.column(at_text)):
                yield cut_rows(batch.slice(at, to - at))

    def cut_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, counts, gone, runs_ = [], [], [], []
        for text, spans in zip(batch.column(at_text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((s["first"], s["first"] + s["lines"]) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            counts.append(0 if text is None else text.count("\n") + 1)
            gone.append(sum(b - a for a, b in merged))
            runs_.append([{"first": a, "lines": b - a} for a, b in merged])
            if merged:
                rows, kept, last = text.split("\n"), [], 0
                for a, b in merged:
                    kept += rows[last:a]
                    last = b
                text = "\n".join(kept + rows[last:])
            out.append(text)
        columns = list(batch.columns[:-1])
        columns[at_text] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(runs_, spans_type)], names=[*docs_columns, *added])

    docs_columns = docs.columns
    return text_batches(joined).mapInArrow(cut, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later copy of a repeated run goes, however few words it has; lines without words stay. The removed runs are given as ``first+lines``."""
    cut = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_words=1)
    return cut.withColumn("removed", F.array_join(F.transform("removed", lambda r: F.concat_ws("+", r["first"].cast("string"), r["lines"].cast("string"))), ","))


# A run of at least one word is repeated exactly if its lines with words are, so that lines tell all.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), m AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone FROM l
), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS island FROM m
), r AS (SELECT doc_id, string_agg(first || '+' || n, ',' ORDER BY first) AS removed FROM (SELECT doc_id, min(i) AS first, count(*) AS n FROM g WHERE gone GROUP BY doc_id, island) GROUP BY 1
), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS left_over, count(*) AS line_count, count(*) FILTER (gone) AS lines_removed FROM m GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_over, '') END AS text, coalesce(line_count, 0)::INT AS line_count, coalesce(lines_removed, 0)::INT AS lines_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
