"""A training corpus from raw documents: filter, clean, deduplicate, pack.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and
all but the last return those columns. ``run`` applies them to ``documents``.

In every stage other columns of the input don't matter, whatever their names; an
empty table gives an empty one; a very long text is taken whole; rows that
repeat each other are treated alike. What nulls and ties do is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import language_id, line_dedup, ngram_jaccard, packing, quality
from lotwise.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this is rejected.
LANGUAGE_FROM = 0.5


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as good (operator 4).

    A null text counts as empty. The prediction follows from the text alone, so
    equal texts stay or go together; doc_id may be null.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels)
    return quality.with_quality(docs, model, [*COLUMNS]).where("predicted = 1").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty (operator 3).

    A null text, or one without a letter, goes. Of equally likely languages the
    first by name counts; a null lang teaches nothing; doc_id may be null.
    """
    model = language_id.train(docs.where(language_id.bucket("doc_id", 5) != 0))
    return language_id.with_language(docs, model, [*COLUMNS]).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_FROM)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs (operator 7); one of which nothing is left goes.

    A null or empty text stays as it is. The first copy is the one in the
    smallest doc_id (null last), rows that repeat doc_id and text being one.
    """
    cut = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = cut.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (operator 1).

    Texts without words, null ones too, link with nothing and stay, as do rows
    without doc_id. Rows that repeat the smallest doc_id are that document and stay.
    """
    others = ngram_jaccard.ngram_jaccard_join(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens (operator 6).

    A null or empty text is its end token alone; repeated rows are packed each;
    a null doc_id stays null.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("language ID", keep_known_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("best-fit packing", pack),
]

#: The trained stages and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
