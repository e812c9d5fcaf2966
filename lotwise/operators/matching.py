"""Matching of listings of several sources by bank, day, price, borrower and unit, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = ["bank", "day"]


def unit_key(value: Column) -> Column:
    """A unit number across notations: f/1 and f1 as 1, 86/b as 86b; ff12 stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]", ""), "^[a-z](?=[0-9])", "")


def unit_twins(rows: DataFrame) -> DataFrame:
    """``rows`` (id, source, bank, day, price, borrower, unit) with ``twin``, the least id of the postings of one unit on one source.

    Postings are one if bank, day, unit, price to the rupee and borrower agree;
    one without a unit is its own.
    """
    same = Window.partitionBy("source", *BUCKET, "unit", F.round("price"), "borrower")
    return rows.withColumn("twin", F.when(F.col("unit").isNull(), F.col("id")).otherwise(F.min("id").over(same)))


def four_field_verdicts(subjects: DataFrame, others: DataFrame) -> DataFrame:
    """(id, verdict, reason, other): each subject against another source's rows of its bank and day.

    Both tables have id, bank, day, price, borrower and unit. One row with equal
    price and borrower is a link, unless both name units that differ; of several
    the one with the subject's unit is; else a reviewer decides: ``batch``,
    ``units_disagree``, ``price_only``, ``borrower_only`` or ``split``. Nothing
    in common is new, and a row that two subjects would link to is contested.

    The others are counted by what they share before they are joined, so a
    subject costs one row a join, however many rows its bank has that day.
    """
    price, person, unit = [*BUCKET, "price"], [*BUCKET, "borrower"], [*BUCKET, "price", "borrower", "unit"]
    both = [*BUCKET, "price", "borrower"]
    by_price = others.groupBy(*price).agg(F.count("*").alias("n_price"))
    by_person = others.groupBy(*person).agg(F.count("*").alias("n_person"))
    by_both = others.groupBy(*both).agg(F.count("*").alias("n_both"), F.min("id").alias("only"), F.min("unit").alias("only_unit"))
    by_unit = others.where("unit IS NOT NULL").groupBy(*unit).agg(F.count("*").alias("n_unit"), F.min("id").alias("of_unit"))
    met = subjects.join(by_price, price, "left").join(by_person, person, "left").join(by_both, both, "left").join(by_unit, unit, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_price", "n_person", "n_both", "n_unit")}
    differ = F.col("unit").isNotNull() & F.col("only_unit").isNotNull() & (F.col("unit") != F.col("only_unit"))
    reason = (
        F.when((n["n_price"] == 0) & (n["n_person"] == 0), "new")
        .when((n["n_both"] == 1) & differ, "units_disagree")
        .when(n["n_both"] == 1, "four_fields")
        .when((n["n_both"] > 1) & (n["n_unit"] == 1), "unit_number")
        .when(n["n_both"] > 1, "batch")
        .when(n["n_person"] == 0, "price_only")
        .when(n["n_price"] == 0, "borrower_only")
        .otherwise("split")
    )
    other = F.when(F.col("reason") == "four_fields", F.col("only")).when(F.col("reason") == "unit_number", F.col("of_unit"))
    judged = met.withColumn("reason", reason).withColumn("other", other)
    claims = judged.where("other IS NOT NULL").groupBy("other").agg(F.count("*").alias("claims")).where("claims > 1")
    final = judged.join(claims, "other", "left").withColumn("reason", F.when(F.col("claims") > 1, "contested").otherwise(F.col("reason")))
    linked = F.col("reason").isin("four_fields", "unit_number")
    verdict = F.when(F.col("reason") == "new", "new").when(linked, "link").otherwise("review")
    return final.select("id", verdict.alias("verdict"), "reason", F.when(linked, F.col("other")).alias("other"))


def decided(verdicts: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts after people's decisions (id, other, approved, snapshot): one made on the facts (id, snapshot) of today comes first, another is ignored.

    An approval links, a rejection makes a link to that row a new subject.
    """
    current = decisions.join(facts, ["id", "snapshot"]).groupBy("id").agg(F.min(F.when(F.col("approved"), F.col("other"))).alias("yes"), F.collect_set(F.when(~F.col("approved"), F.col("other"))).alias("no"))
    joined = verdicts.join(current, "id", "left")
    refused = F.coalesce(F.array_contains("no", F.col("other")), F.lit(False))
    return joined.select(
        "id",
        F.when(F.col("yes").isNotNull(), "link").when(refused, "new").otherwise(F.col("verdict")).alias("verdict"),
        F.when(F.col("yes").isNotNull(), "decision").when(refused, "rejected").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("yes").isNotNull(), F.col("yes")).when(~refused, F.col("other")).alias("other"),
    )


def picked_price(portal: Column, notice: Column, verdict: Column) -> Column:
    """A struct of the price that counts, where it is from and the verdict: the portal's if they agree, whichever is there if one is missing, else the notice's."""
    side = F.when(verdict == "agree", "portal").when(verdict == "unknown", F.when(portal.isNotNull(), "portal").when(notice.isNotNull(), "notice")).otherwise("notice")
    return F.struct(F.when(side == "portal", portal).when(side == "notice", notice).alias("price"), side.alias("source"), verdict.alias("agreement"))


def strongest(edges: DataFrame, ends: list[str], grade: str, order: list[str]) -> DataFrame:
    """One edge for each pair of ends, of the best grade (first in ``order``), with the number of edges that it stands for."""
    rank = F.coalesce(*[F.when(F.col(grade) == g, F.lit(i)) for i, g in enumerate(order)], F.lit(len(order)))
    return edges.groupBy(*ends).agg(F.min_by(grade, rank).alias(grade), F.count("*").alias("edges"))


def first_angle(searches: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of several searches, each key once: under the first search that found it."""
    out = None
    for i, (name, rows) in enumerate(searches):
        one = rows.select(key, F.lit(i).alias("_i"), F.lit(name).alias("angle"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by("angle", "_i").alias("angle"), F.count_distinct("_i").alias("angles"))


def compared_rows(new: DataFrame, known: DataFrame, key: str, body: list[str]) -> DataFrame:
    """(key, state): ``new`` keys that aren't known, ``known`` ones with an equal body, ``variant`` ones with another, ``ambiguous`` ones that are known several times."""
    digest = F.sha2(F.to_json(F.struct(*body)), 256)
    held = known.groupBy(key).agg(F.count("*").alias("_n"), F.min(digest).alias("_body"))
    state = F.when(F.col("_n").isNull(), "new").when(F.col("_n") > 1, "ambiguous").when(F.col("_body") == digest, "known").otherwise("variant")
    return new.join(held, key, "left").select(key, state.alias("state"))


def latest_decisions(log: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The decision in force for each key of a log (key, action, when): the last; ``undo`` takes back the one before it, so a key may have none."""
    order = Window.partitionBy(key).orderBy(when, tie)
    later = Window.partitionBy(key).orderBy(F.desc(when), F.desc(tie))
    # an undo takes back the row right before it if that isn't an undo itself
    gone = F.coalesce(F.lead("action").over(order) == "undo", F.lit(False))
    standing = log.withColumn("_gone", gone).where("action <> 'undo' AND NOT _gone")
    return standing.withColumn("_i", F.row_number().over(later)).where("_i = 1").drop("_i", "_gone")


def richest(rows: DataFrame, same: list[str], fields: list[str], key: str) -> DataFrame:
    """Of rows that agree on ``same`` the one with the most fields that aren't null, ties by key, and how many there were."""
    filled = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return rows.groupBy(*same).agg(F.min_by(key, F.struct(-filled, F.col(key))).alias(key), F.max(filled).alias("filled"), F.count("*").alias("copies"))
