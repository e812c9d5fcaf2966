"""Which lot of its notice a listing is, by evidence, and why every other lot was refused.

Each listing meets the lots of its own notice. Keys narrow its candidates in
order of trust, each only where it leaves some: reserve price, deposit,
borrower, and what only one candidate's identifiers say. The lot's own claim to
be a listing is checked against what the keys say, never obeyed against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 0.01

# What is said of each outcome.
REASONS = {
    "single": "the notice has one lot",
    "exact": "the reserve price is this lot's",
    "tolerance": "the reserve price is this lot's within one percent",
    "emd": "the deposit is this lot's",
    "emd_tolerance": "the deposit is this lot's within one percent",
    "borrower": "the borrower is this lot's",
    "identifier": "an identifier of the listing names only this lot",
    "portal_aid": "the lot names the listing, and no figure contradicts it",
    "remainder": "the last listing without a lot and the last free lot",
    "ambiguous": "several lots agree on everything that is known",
    "portal_aid_conflict": "the lot that names the listing isn't the one that its figures name",
    "none": "nothing of the listing is any lot's",
    "no_listing_price": "the listing has no price, deposit or borrower",
}


def _said(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[tier]


def _judged(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """doc, listing, tier, left and gone of every listing whose notice has lots; see :func:`evidence`.

    left and gone are arrays of (lot, refused_by) with the lots that are left and
    those ruled out, so that a listing is judged in one row, without a sort of pairs.
    """
    none = F.array().cast("array<string>")
    own = listings.select("doc", "listing", "price", "emd", F.coalesce("borrowers", none).alias("borrowers"), F.coalesce("ids", none).alias("ids"))
    claims = Window.partitionBy("doc", "portal_aid")
    theirs = lots.select("doc", "lot", "reserve", F.col("emd").alias("lot_emd"), F.coalesce("borrowers", none).alias("lot_borrowers"), F.coalesce("ids", none).alias("lot_ids"), F.when(F.count("*").over(claims) == 1, F.col("portal_aid")).alias("aid"))
    notices = theirs.groupBy("doc").agg(F.collect_list(F.struct("lot", "reserve", "lot_emd", "lot_borrowers", "lot_ids", "aid")).alias("left"), F.bool_or(F.col("aid").isNotNull()).alias("_claims"))
    m = own.join(notices, "doc")
    pair = lambda x, key: F.struct(x["lot"].alias("lot"), F.lit(key).cast("string").alias("refused_by"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    claimed = lambda x: sure(x["aid"] == F.col("listing"))
    nobody = F.array().cast(f"array<struct<lot:{dict(lots.dtypes)['lot']},refused_by:string>>")
    m = m.withColumns({"n_lots": F.size("left"), "_named": F.col("_claims") & F.exists("left", claimed), "tier": F.lit(None).cast("string"), "gone": nobody})

    def without(hit: Callable[[Column], Column]) -> Column:
        return F.filter("left", lambda x: ~hit(x))

    def narrowed(m: DataFrame, key: str, others: Column, use: Column, tier: Column) -> DataFrame:
        """Where ``use`` holds and some candidates are hit (in _hit), the others go."""
        use = use & (F.size("_hit") > 0)
        others = F.transform(others, lambda x: pair(x, key))
        some = use & (F.size("_hit") < F.size("left"))
        return m.withColumns({"gone": F.when(some, F.concat("gone", others)).otherwise(F.col("gone")), "tier": F.coalesce("tier", F.when(use, tier)), "left": F.when(some, F.col("_hit")).otherwise(F.col("left"))})

    def same(mine: str, lot: str) -> Callable[[Column], Column]:
        return lambda x: sure(F.col(mine) == x[lot])

    def near(mine: str, lot: str) -> Callable[[Column], Column]:
        return lambda x: sure(F.abs(F.col(mine) - x[lot]) <= TOLERANCE * F.abs(x[lot]))

    several = F.size("left") > 1
    for key, mine, lot, tiers, use in (("price", "price", "reserve", ("exact", "tolerance"), F.lit(True)), ("emd", "emd", "lot_emd", ("emd", "emd_tolerance"), several)):
        m = m.withColumn("_hit", F.when(F.col(mine).isNotNull(), F.filter("left", same(mine, lot))))
        m = m.withColumn("_exact", F.size("_hit") > 0).withColumn("_hit", F.when(F.col("_exact"), F.col("_hit")).when(F.col(mine).isNotNull(), F.filter("left", near(mine, lot))))
        m = narrowed(m, key, F.when(F.col("_exact"), without(same(mine, lot))).otherwise(without(near(mine, lot))), use, F.when(F.col("_exact"), tiers[0]).otherwise(tiers[1])).drop("_hit", "_exact")
    # names and identifiers count only where they part the candidates
    met = lambda x: sure(F.arrays_overlap(F.col("borrowers"), x["lot_borrowers"]))
    m = m.withColumn("_hit", F.when(several & (F.size("borrowers") > 0), F.filter("left", met)))
    m = m.withColumn("_alone", F.size("_hit") == 1)
    m = narrowed(m, "borrower", without(met), F.size("_hit") < F.size("left"), F.lit("borrower")).withColumn("tier", F.when(F.col("_alone"), "borrower").otherwise(F.col("tier"))).drop("_hit", "_alone")
    asked = several & (F.size("ids") > 0)
    shared = F.aggregate(F.transform("left", lambda x: x["lot_ids"]), F.element_at("left", 1)["lot_ids"], F.array_intersect)
    m = m.withColumn("_own", F.when(asked, F.array_except("ids", F.when(asked, shared))))
    told = lambda x: F.size(F.array_intersect(F.col("_own"), x["lot_ids"])) > 0
    m = m.withColumn("_hit", F.when(asked, F.filter("left", told)))
    m = m.withColumn("_one", F.size("_hit") == 1)
    m = narrowed(m, "identifier", without(told), F.col("_one"), F.lit("identifier")).withColumn("tier", F.when(F.col("_one"), "identifier").otherwise(F.col("tier"))).drop("_own", "_hit", "_one")
    nothing = F.col("price").isNull() & F.col("emd").isNull() & (F.size("borrowers") == 0)
    tier = (
        F.when(F.col("n_lots") == 1, "single")
        .when(nothing & ~F.col("_named"), "no_listing_price")
        .when(F.col("_named") & ~F.exists("left", claimed), "portal_aid_conflict")
        .when(F.col("_named") & several, "portal_aid")
        .when(F.size("left") == 1, F.col("tier"))
        .otherwise(F.when(F.col("tier").isNull(), "none").otherwise("ambiguous"))
    )
    out = m.withColumn("tier", tier)
    by_claim = sure(F.col("tier") == "portal_aid")
    unclaimed = F.transform(F.filter("left", lambda x: ~claimed(x)), lambda x: pair(x, "claim"))
    kept = F.when(by_claim, F.filter("left", claimed)).otherwise(F.col("left"))
    return out.select("doc", "listing", "tier", F.transform(kept, lambda x: pair(x, None)).alias("left"), F.when(by_claim, F.concat("gone", unclaimed)).otherwise(F.col("gone")).alias("gone"))


def evidence(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """A row for each listing and lot of a notice: doc, listing, lot, refused_by (null for what is left), tier.

    ``listings``: doc, listing, price, emd, borrowers, ids, a row for each listing;
    ``lots``: doc, lot, reserve, emd, borrowers, ids and portal_aid (the listing
    that it claims to be). borrowers and ids are arrays of words; any field may be
    null. tier is the first key that said something, by the whole listing;
    refused_by is the key that ruled the lot out (price, emd, borrower, identifier,
    claim). A lot claimed to be a listing by several lots, or to be one of another
    notice, is claimed by none.
    """
    each = _judged(listings, lots).select("doc", "listing", "tier", F.explode(F.concat("left", "gone")).alias("_pair"))
    return each.select("doc", "listing", "_pair.lot", "_pair.refused_by", "tier")


def explained(matrix: DataFrame) -> DataFrame:
    """doc, listing, outcome, tier, lot, rivals, reason of every listing of :func:`evidence`.

    outcome: ``linked``; ``rival``, where another listing has the same lot (they
    are named in rivals, joined by commas); ``unmatched``. Where a notice has one
    listing that nothing places and one lot that nobody has, they belong together.
    """
    lots = F.transform(F.collect_set(F.struct("lot")), lambda x: x["lot"])
    return _outcomes(matrix.groupBy("doc", "listing", "tier").agg(F.min(F.when(F.col("refused_by").isNull(), F.col("lot"))).alias("lot"), lots.alias("_lots")))


def explanations(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """The same as :func:`explained` of the :func:`evidence`, without a row for each pair."""
    lot = lambda x: x["lot"]
    return _outcomes(_judged(listings, lots).select("doc", "listing", "tier", F.array_min(F.transform("left", lot)).alias("lot"), F.transform(F.concat("left", "gone"), lot).alias("_lots")))


def _outcomes(one: DataFrame) -> DataFrame:
    """What :func:`explained` says, from doc, listing, tier, lot (the least that is left) and _lots (all of the notice)."""
    placed = F.col("tier").isin("single", "exact", "tolerance", "emd", "emd_tolerance", "borrower", "identifier", "portal_aid")
    one = one.withColumn("lot", F.when(placed, F.col("lot")))
    notice = Window.partitionBy("doc")
    one = one.withColumns({"_taken": F.collect_set("lot").over(notice), "_lost": F.count_if(F.col("lot").isNull()).over(notice)})
    lost = (F.col("tier") == "none") & (F.col("_lost") == 1)
    one = one.withColumn("_free", F.when(lost, F.array_except("_lots", "_taken"))).drop("_lots", "_taken")
    last = F.coalesce(F.size("_free") == 1, F.lit(False))
    one = one.withColumns({"lot": F.when(last, F.array_min("_free")).otherwise(F.col("lot")), "tier": F.when(last, "remainder").otherwise(F.col("tier"))})
    same = Window.partitionBy("doc", "lot")
    one = one.withColumn("_all", F.when(F.col("lot").isNotNull() & (F.col("tier") != "single"), F.collect_set("listing").over(same)))
    rivals = F.array_sort(F.array_except("_all", F.array("listing")))
    one = one.withColumn("_rivals", F.coalesce(rivals, F.array().cast(dict(one.dtypes)["_all"])))
    outcome = F.when(F.col("lot").isNull(), "unmatched").when(F.size("_rivals") > 0, "rival").otherwise("linked")
    reason = F.when(outcome == "rival", F.concat(F.lit("matched because "), _said(F.col("tier")), F.lit(", but so did "), F.array_join(F.col("_rivals").cast("array<string>"), ", "))).otherwise(_said(F.col("tier")))
    return one.select("doc", "listing", outcome.alias("outcome"), "tier", "lot", F.array_join(F.col("_rivals").cast("array<string>"), ",").alias("rivals"), reason.alias("reason"))
