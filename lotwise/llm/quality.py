"""Quality classifier as a sparse rule ensemble (operator 4).

Statistics of each whole text; a small forest on a bounded sample of labelled
rows, whose root-to-node paths become conjunctive rules; lasso logistic weights
over these rules; and the surviving rules compiled into one Spark expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import bucket
from .shared import text_batches
from .textkit import keep_nothing, per_row, span_hashes, text_slices, word_spans

#: Labelled rows that the model is fitted to, about (chosen by a hash of doc_id).
SAMPLE_ROWS = 10_000
TREES = 24
DEPTH = 3
LASSO = 0.001
GOOD_FROM = 0.7

STATS = ["log_bytes", "log_words", "word_bytes", "upper", "letters", "digits", "symbols", "pipes", "marks", "stops", "wide", "lines_per_word", "distinct_words", "one_byte_words", "log_longest_line", "mixed_words"]

_KINDS = np.zeros((256, 8), np.float32)
for _column, _chars in enumerate([range(65, 91), [*range(65, 91), *range(97, 123), *range(128, 256)], range(48, 58), b"#$%&*@^_~=+<>\\/{}[]", b"|", b"!?", b".,;:", range(192, 256)]):
    _KINDS[list(_chars), _column] = 1
_COLUMNS = np.ascontiguousarray(_KINDS.T)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS of each row, from its bytes."""
    n, size = len(offsets) - 1, np.diff(offsets)
    shares = np.zeros((n, _KINDS.shape[1]))
    for k in range(_KINDS.shape[1]):
        shares[:, k] = per_row(np.add, _COLUMNS[k][data], offsets)
    shares /= np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    length = ends - starts
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    cuts = np.union1d(np.concatenate((breaks, offsets[:-1], offsets[1:])), [0])
    runs = np.diff(cuts)
    owner = np.searchsorted(offsets, cuts[:-1], "right") - 1
    longest = np.zeros(n)
    np.maximum.at(longest, owner[owner < n], runs[owner < n])
    letter_first = _KINDS[:, 1][data[starts]] > 0 if len(starts) else np.zeros(0, bool)
    symbol_last = (_KINDS[:, 2:6][data[ends - 1]].any(1)) if len(ends) else np.zeros(0, bool)
    mixed = np.bincount(row, letter_first & symbol_last, minlength=n)
    many = np.maximum(words, 1)
    out = np.zeros((n, len(STATS)))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = np.bincount(row, length, minlength=n) / many
    out[:, 3:11] = shares
    out[:, 11], out[:, 12] = lines / many, distinct / many
    out[:, 13] = np.bincount(row, length == 1, minlength=n) / many
    out[:, 14], out[:, 15] = np.log1p(longest), mixed / many
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and STATS of its text (a null counts as empty), each rounded to 6 places."""
    kinds = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), *(f"{s} double" for s in STATS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(at_text)):
                values = np.round(_statistics(data, offsets), 6)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[: len(keep)]), *(pa.array(values[:, k]) for k in range(len(STATS)))], names=[*keep, *STATS])

    at_text = keep.index("text") if "text" in keep else len(keep)
    return text_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(measure, schema)


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold) ...


def tree_rules(node, path: Rule = ()) -> Iterator[Rule]:
    """The path to each node below the root of a fitted tree (its JVM node), as a conjunction."""
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = STATS[split.featureIndex()], round(split.threshold(), 6)
    for child, most in ((node.leftChild(), True), (node.rightChild(), False)):
        rule = tuple(sorted({*path, (name, most, at)}))
        yield rule
        yield from tree_rules(child, rule)


def rule_column(rule: Rule) -> Column:
    """1.0 where the conjunction holds, else 0.0."""
    held = F.lit(True)
    for name, most, at in rule:
        held = held & (F.col(name) <= at if most else F.col(name) > at)
    return F.when(held, 1.0).otherwise(0.0)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1, from STATS columns alone."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + weight * rule_column(rule)
        return 1 / (1 + F.exp(-total))


def fit_rules(sample: DataFrame) -> RuleEnsemble:
    """Fit to a bounded sample with STATS and quality (0 or 1)."""
    spark = sample.sparkSession
    rows = sample.select("quality", *STATS).orderBy(*STATS, "quality").toPandas()
    good = int((rows["quality"] == 1).sum())
    if not 0 < good < len(rows):  # one label, or none: the smoothed share
        share = (good + 0.5) / (len(rows) + 1)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    local = spark.createDataFrame(rows.astype(float)).coalesce(1)
    features = VectorAssembler(inputCols=STATS, outputCol="statistics")
    table = features.transform(local).select("quality", "statistics", *STATS).cache()
    forest = RandomForestClassifier(labelCol="quality", featuresCol="statistics", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=max(2, len(rows) // 400), featureSubsetStrategy="onethird").fit(table)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree._call_java("rootNode"))})
    table.unpersist()
    held = local.select("quality", F.array(*map(rule_column, rules)).alias("held"))
    vectors = held.select("quality", array_to_vector("held").alias("rules")).cache()
    lasso = LogisticRegression(labelCol="quality", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(vectors)
    vectors.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), [(rule, float(w)) for rule, w in zip(rules, weights.tolist(), strict=True) if w])


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Fit to documents and labels (doc_id, quality) where crc32(doc_id as text) mod 4 is not 2.

    Labels other than 0 and 1 teach nothing; a doc_id with several labels takes
    the least, and a repeated doc_id its least text. About SAMPLE_ROWS labelled rows are used, chosen by a hash of
    doc_id, and only their ids (a checked, bounded number) are broadcast.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = usable.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) < share * 1_000_000)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = some.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("first")).select("first.*")
    return fit_rules(with_statistics(first, ["quality"]))


def with_quality(docs: DataFrame, model: RuleEnsemble, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score (0 to 1) and predicted (0 or 1) of each row.

    Kept columns named like a statistic stay; those named score or predicted
    give way to the new ones.
    """
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    held = F.struct(*keep).alias("_kept")
    text = docs.select(held, F.col("text").alias("text"))
    scored = with_statistics(text, ["_kept"]).select("_kept.*", F.round(model.score(), 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    A null text counts as empty; every row has a score, a very long text from
    its whole. A score follows from the text alone, so repeated rows and ties get
    equal ones. A row without doc_id isn't held out. Without labels of both kinds
    the score is their smoothed share. Other columns don't matter, whatever their
    names; an empty table gives none.
    """
    model = train(docs, labels)
    out = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False))
    return with_quality(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
