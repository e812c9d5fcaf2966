"""Resolution of names, places, identifiers and of answers against their sources."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import damerau_levenshtein, token_sort_ratio

# How sure a link is, by the method that made it.
CONFIDENCE = {"human": "CONFIRMED", "document": "CONFIRMED", "four_field": "CONFIRMED", "unit": "PROBABLE", "price_and_day": "PROBABLE", "borrower": "INFERRED"}


def confidence(method: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return F.coalesce(F.try_element_at(table, method), F.lit("UNKNOWN"))


def ocr_variants(names: DataFrame, name: str, edits: int = 2, share: float = 0.3) -> DataFrame:
    """Pairs of names that differ in one word on each side, by few edits: (a, b).

    Names meet on the rest of their words, one dropped in turn, so only names
    that could be variants are compared.
    """
    w = names.select(F.col(name).alias("name"), F.array_sort(F.array_distinct(F.split(F.lower(name), r"\s+"))).alias("w")).distinct()
    one_less = w.select("name", F.explode(F.transform("w", lambda x: F.struct(x.alias("word"), F.array_join(F.array_remove(F.col("w"), x), " ").alias("rest")))).alias("d")).select("name", "d.word", "d.rest")
    a, b = one_less.toDF("a", "wa", "rest"), one_less.toDF("b", "wb", "rest")
    pairs = a.join(b, "rest").where((F.col("a") < F.col("b")) & (F.col("wa") != F.col("wb")) & (F.abs(F.length("wa") - F.length("wb")) <= edits))
    n = damerau_levenshtein("wa", "wb")
    return pairs.withColumn("edits", n).where((F.col("edits") <= edits) & (F.col("edits") <= share * F.greatest(F.length("wa"), F.length("wb")))).select("a", "b").distinct()


def merge_proposals(names: DataFrame, name: str, block: Column, floor: float = 88.0) -> DataFrame:
    """Pairs of a block whose sorted words are alike, for a reviewer: (a, b, score)."""
    rows = names.select(F.col(name).alias("n"), block.alias("block")).where("block IS NOT NULL").distinct()
    pairs = rows.toDF("a", "block").join(rows.toDF("b", "block"), "block").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("score", F.round(token_sort_ratio(F.lower("a"), F.lower("b")), 2)).where(F.col("score") >= floor)


def hinted(rows: DataFrame, key: str, hints: list[DataFrame], answer: str) -> DataFrame:
    """An answer from hints only if all that say something say the same: (key, answer, hints)."""
    said = hints[0]
    for more in hints[1:]:
        said = said.unionByName(more)
    one = said.where(F.col(answer).isNotNull()).groupBy(key).agg(F.min(answer).alias(answer), F.countDistinct(answer).alias("_n"), F.count("*").alias("hints")).where("_n = 1").drop("_n")
    return rows.join(one, key, "left").select(key, answer, F.coalesce("hints", F.lit(0)).alias("hints"))


def find_identifier(lots: DataFrame, parcels: DataFrame, value: str, key: str, identifier: str) -> DataFrame:
    """Keys whose lot or parcel has the identifier, by either path, each once with the paths that found it."""
    norm = F.regexp_replace(F.lower(F.trim(F.col(identifier).cast("string"))), r"\s+", "")
    wanted = "".join(value.lower().split())
    hit = lambda df, path: df.where(norm == wanted).select(key, F.lit(path).alias("path"))
    return hit(lots, "lot").unionByName(hit(parcels, "parcel")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def ungrounded(said: Column, sources: Column, pattern: str) -> Column:
    """What matches of the pattern stand in an answer but in none of its sources' text."""
    find = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)))
    return F.array_sort(F.array_except(find(said), find(sources)))


def first_mentions(rows: DataFrame, thread: str, turn: str, answers: Column, text: str, pattern: str) -> DataFrame:
    """Per row that is an answer: thread, turn, n_new and new_names, the matches in it that no earlier turn of its thread has.

    The first turn of each match is found by one aggregate, so a long thread isn't
    carried along with each of its turns. A match lies within one text; rows of
    one turn don't count as earlier than each other.
    """
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)))
    held = rows.select(thread, turn, answers.alias("_answer"), found.alias("_found"))
    first = held.select(thread, turn, F.explode("_found").alias("_name")).groupBy(thread, "_name").agg(F.min(turn).alias(turn))
    new = first.groupBy(thread, turn).agg(F.collect_list("_name").alias("_new"))
    fresh = F.array_sort(F.array_intersect("_found", F.coalesce("_new", F.array().cast("array<string>"))))
    out = held.where("_answer").join(new, [thread, turn], "left").withColumn("_fresh", fresh)
    return out.select(thread, turn, F.size("_fresh").cast("long").alias("n_new"), F.array_join("_fresh", ",").alias("new_names"))


def expanded_bundles(files: DataFrame) -> DataFrame:
    """A row per file in zip bundles (path, content): path, member, size, content; a file that is no zip gives none."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None or not zipfile.is_zipfile(BytesIO(content)):
                    continue
                with zipfile.ZipFile(BytesIO(content)) as bundle:
                    for info in bundle.infolist():
                        if not info.is_dir():
                            data = bundle.read(info)
                            yield pd.DataFrame([(path, info.filename, len(data), data)], columns=["path", "member", "size", "content"])

    return files.select("path", "content").mapInPandas(expand, "path string, member string, size long, content binary")


def numbered_parts(texts: DataFrame, key: str, text: str, pattern: str = r"(?:^|\n)\s*(\d{1,3})[.)]\s") -> DataFrame:
    """Parts of a text under the longest chain of printed numbers 1, 2, 3, ..: key, number, part. Fewer than two give none."""
    marks = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    parts = F.split(F.col(text), r"(?:^|\n)\s*\d{1,3}[.)]\s")
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<number:int,at:int>>").alias("found"), F.lit(0).alias("i"))

    def step(s: Column, m: Column) -> Column:
        n, fits = m.cast("int"), m.cast("int") == s["last"] + 1
        found = F.when(fits, F.concat(s["found"], F.array(F.struct(n.alias("number"), (s["i"] + 1).alias("at"))))).otherwise(s["found"])
        return F.struct(F.when(fits, n).otherwise(s["last"]).alias("last"), found.alias("found"), (s["i"] + 1).alias("i"))

    chained = texts.select(key, parts.alias("_parts"), F.aggregate(marks, start, step, lambda s: s["found"]).alias("_chain")).where(F.size("_chain") >= 2)
    return chained.select(key, "_parts", F.explode("_chain").alias("c")).select(key, F.col("c.number").alias("number"), F.trim(F.get("_parts", F.col("c.at"))).alias("part"))


def page_groups(pages: DataFrame, by: str, page: str, content: str) -> DataFrame:
    """Pages of one document in order, whether the order agrees for all its copies, and why not: (group, pages, copies, verdict)."""
    seq = pages.groupBy(by, "copy").agg(F.transform(F.array_sort(F.collect_list(F.struct(page, content))), lambda p: p[content]).alias("order"))
    return seq.groupBy(by).agg(F.count("*").alias("copies"), F.countDistinct("order").alias("orders"), F.max(F.size("order")).alias("pages")).select(by, "pages", "copies", F.when(F.col("copies") == 1, "single").when(F.col("orders") == 1, "agreed").otherwise("ambiguous").alias("verdict"))
