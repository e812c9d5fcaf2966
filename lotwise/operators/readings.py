"""Readings of notices: checks of what was extracted, anchors across re-reads, gold scores, comparisons of readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import partial_ratio, ratio
from .linkage import components
from .notices import PENALTY

# What a notice may state, and the bounds of its prices.
POSSESSIONS = ["physical", "symbolic", "constructive"]
LEGAL_BASES = ["SARFAESI", "DRT", "IBC", "other"]
RESERVE_RANGE = (1e4, 1e10)
DEPOSIT_SHARE = (0.04, 0.25)
#: Classes that a lot's description has to cover.
DETAILS = ["property", "location", "extent", "identifier", "boundary"]


def described(entities: DataFrame) -> DataFrame:
    """(notice, lot, short, elsewhere, bare) of each lot with details: details outside its description, those inside another lot's, and whether it has no description.

    entities: notice, cls, lot, start, stop (null where a value has no place in
    the text; such a detail is not judged). A detail inside its own description
    is covered, whatever other description holds it too.
    """
    spans = entities.where("cls = 'full_description' AND start IS NOT NULL").select("notice", F.col("lot").alias("of"), F.col("start").alias("a"), F.col("stop").alias("b")).distinct()
    details = entities.where(F.col("cls").isin(DETAILS) & F.col("start").isNotNull()).groupBy("notice", "lot").agg(F.collect_set(F.struct("start", "stop")).alias("_all"))
    own = spans.groupBy("notice", F.col("of").alias("lot")).agg(F.collect_list(F.struct("a", "b")).alias("_own"))
    covered = lambda d: F.exists("_own", lambda s: (s["a"] <= d["start"]) & (d["stop"] <= s["b"]))
    lots = details.join(own, ["notice", "lot"], "left").withColumn("_left", F.when(F.col("_own").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda d: ~F.coalesce(covered(d), F.lit(False)))))
    lots = lots.select("notice", "lot", "_left", F.col("_own").isNull().alias("bare"))
    # only what its own description doesn't hold is looked for in the others of the notice; a lot of which nothing is left keeps a row
    left = lots.select("notice", "lot", "bare", F.inline_outer("_left")).join(spans.select(F.col("notice").alias("_in"), "a", "b"), F.expr("notice = _in AND lot IS NOT NULL AND a <= start AND stop <= b"), "left")
    left = left.groupBy("notice", "lot", "bare", "start", "stop").agg(F.bool_or(F.col("a").isNotNull()).alias("_other"))
    counted = left.groupBy("notice", "lot", "bare").agg(F.count(F.when(F.col("start").isNotNull() & ~F.col("_other"), 1)).alias("short"), F.count(F.when(F.col("_other"), 1)).alias("elsewhere"))
    return counted.select("notice", "lot", "short", "elsewhere", "bare")


def notice_facts(entities: DataFrame, notices: DataFrame, kinds: list[str]) -> DataFrame:
    """What the checks ask of each notice, from its entities by lot and then by notice.

    entities: notice, cls, lot, kind, value, number, start, stop; notices:
    notice and markers (numbered lot marks in its text). ``kinds`` are the
    identifier kinds that exist. Every notice gets a row, also one without entities.
    """
    is_ = lambda c: F.col("cls") == c
    kind = lambda k: F.col("kind") == k
    area = lambda *kinds: F.collect_set(F.when(is_("extent") & F.col("kind").isin(*kinds), F.col("number") + 0.0))  # noqa: E731  a negative zero is zero
    # a lot's entities come from many tasks, so that they are dealt by notice as they are, once for all sums
    lots = entities.repartition("notice").groupBy("notice", "lot").agg(
        F.bool_or(is_("property")).alias("property"),
        F.max(F.when(is_("property"), F.lower("value"))).alias("type"),
        F.max(F.when(is_("possession"), F.lower("value"))).alias("possession"),
        F.min(F.when(kind("reserve_price"), F.col("number"))).alias("reserve"),
        F.min(F.when(kind("reserve_price"), F.col("start"))).alias("reserve_at"),
        F.min(F.when(kind("emd"), F.col("number"))).alias("emd"),
        F.bool_or(is_("borrower")).alias("borrower"),
        F.bool_or(is_("location")).alias("location"),
        F.bool_or(is_("extent") & kind("uds")).alias("uds"),
        F.min(F.when(is_("full_description"), F.col("start"))).alias("described_at"),
        F.count("*").alias("n"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("loose"),
        F.count(F.when(F.lower("value").isin("null", ""), 1)).alias("nulls"),
        F.count(F.when(is_("identifier") & ~F.col("kind").isin(kinds), 1)).alias("odd_kinds"),
        F.count(F.when(is_("extras"), 1)).alias("extras"),
        F.bool_or(is_("secured_creditor")).alias("creditor"),
        F.max(F.when(is_("secured_creditor"), F.col("value"))).alias("basis"),
        F.bool_or(is_("extent")).alias("extent"),
        # an area of the whole that is given as the lot's own, too
        F.arrays_overlap(area("uds_parent"), area("extent", "total")).alias("echo"),
    )
    # two lots stand crossed where prices don't follow the order of descriptions
    placed = F.col("described_at").isNotNull() & F.col("reserve_at").isNotNull()
    before = F.max(F.when(placed, F.col("reserve_at"))).over(Window.partitionBy("notice").orderBy("described_at", "lot").rowsBetween(Window.unboundedPreceding, -1))
    lots = lots.withColumn("crossed", placed & (before > F.col("reserve_at")))
    cover = described(entities).groupBy("notice").agg(F.bool_or("bare").alias("bare"), F.bool_or(~F.col("bare") & (F.col("short") > 0)).alias("short"), F.bool_or(F.col("elsewhere") > 0).alias("elsewhere"))
    some = lambda c: F.count(F.when(c, 1))
    share = F.col("emd") / F.col("reserve")
    by_notice = lots.groupBy("notice").agg(
        F.sum("n").alias("n"),
        F.count("lot").alias("lots"),
        some(F.col("creditor")).alias("creditors"),
        some(F.col("borrower")).alias("borrowers"),
        some(F.col("location")).alias("locations"),
        some(F.col("reserve").isNotNull()).alias("reserves"),
        some(F.col("extent")).alias("extents"),
        some(F.col("property")).alias("properties"),
        some(F.col("property") & F.col("type").isNull()).alias("untyped"),
        some(F.col("possession").isNotNull() & ~F.col("possession").isin(POSSESSIONS)).alias("bad_possession"),
        some(F.col("property") & F.col("type").contains("flat") & ~F.coalesce("uds", F.lit(False))).alias("no_uds"),
        F.sum("loose").alias("loose"),
        F.sum("nulls").alias("nulls"),
        F.sum("odd_kinds").alias("odd_kinds"),
        F.sum("extras").alias("extras"),
        F.max("basis").alias("basis"),
        some(~F.col("reserve").between(*RESERVE_RANGE)).alias("bad_reserve"),
        some((F.col("emd") > 0) & (F.col("reserve") > 0) & ~share.between(*DEPOSIT_SHARE)).alias("bad_emd"),
        F.bool_or("crossed").alias("crossed"),
        some(F.col("echo")).alias("parent_as_own"),
    )
    facts = notices.select("notice", "markers").join(by_notice, "notice", "left").join(cover, "notice", "left")
    return facts.na.fill(0, [c for c, t in facts.dtypes if t in ("bigint", "int") and c != "notice"]).na.fill(False, ["crossed", "bare", "short", "elsewhere"])


#: Code, severity and condition on ``notice_facts``; a code counts once a notice. Codes and severities are fixed values.
NOTICE_RULES = [
    ("missing_secured_creditor", "high", "creditors = 0"),
    ("missing_borrower", "high", "borrowers = 0"),
    ("missing_location", "med", "locations = 0"),
    ("missing_reserve_price", "high", "reserves = 0"),
    ("missing_extent", "high", "extents = 0"),
    ("missing_property_type", "high", "untyped > 0"),
    ("possession_type_invalid", "high", "bad_possession > 0"),
    ("missing_uds", "high", "no_uds > 0"),
    ("lot_missing_reserve", "high", "properties > 1 AND reserves < properties"),
    ("lot_missing_borrower", "high", "properties > 1 AND borrowers < properties"),
    ("lot_missing_location", "high", "properties > 1 AND locations BETWEEN 1 AND properties - 1"),
    ("ungrounded", "low", "loose > 0 AND loose < 0.05 * n"),
    ("ungrounded", "med", "loose >= 0.05 * n AND loose < 0.2 * n"),
    ("ungrounded", "high", "loose > 0 AND loose >= 0.2 * n"),
    ("null_value", "low", "nulls > 0"),
    ("kind_invalid", "low", "odd_kinds > 0"),
    ("extras_excess", "low", "extras > 5"),
    ("legal_basis_bad", "low", "NOT coalesce(basis IN (" + ", ".join(f"'{b}'" for b in LEGAL_BASES) + "), false)"),
    ("reserve_out_of_range", "med", "bad_reserve > 0"),
    ("emd_ratio_off", "low", "bad_emd > 0"),
    ("uds_parent_as_own_area", "high", "parent_as_own > 0"),
    ("lot_under_recall", "med", "markers >= 3 AND 2 * lots < markers"),
    ("missing_full_description", "critical", "bare"),
    ("full_description_incomplete", "high", "short"),
    ("detail_wrong_lot", "med", "elsewhere"),
    ("lot_pairing_off", "med", "crossed"),
]


def notice_issues(facts: DataFrame) -> DataFrame:
    """notice, issues (sorted codes, joined by commas) and score: 100 less the penalties, 0 at least."""
    codes = F.array_sort(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, _, c in NOTICE_RULES])))
    lost = reduce(lambda a, b: a + b, [F.when(F.expr(c), PENALTY[s]).otherwise(0) for _, s, c in NOTICE_RULES])
    return facts.select("notice", F.array_join(codes, ",").alias("issues"), F.greatest(F.lit(0), 100 - lost).alias("score"))


def reanchored(old: DataFrame, new: DataFrame, share: float = 0.5, partly: float = 70, wholly: float = 90) -> DataFrame:
    """(doc, id, anchor): the entity of the new reading that each entity of the old one is, else ``orphaned:<id>``.

    Both: doc, id, cls, lot, start, stop, text. An old lot is the new one whose
    spans meet its own most, descriptions first. There an entity of the same
    class counts that meets at least ``share`` of the shorter span with texts
    partly alike, else one of equal or nearly equal text; of several the nearest.
    """
    n = new.select("doc", "cls", *[F.col(c).alias(f"new_{c}") for c in ("id", "lot", "start", "stop", "text")])
    meet = F.greatest(F.lit(0), F.least("stop", "new_stop") - F.greatest("start", "new_start"))
    described_ = F.when(F.col("cls") == "description", F.col("meet")).otherwise(0)
    # spans alone say which lots meet; texts join only those of one lot and its new one
    spans = old.select("doc", "cls", "lot", "start", "stop").join(n.drop("new_id", "new_text"), ["doc", "cls"]).withColumn("meet", meet)
    shared = spans.where("meet > 0").groupBy("doc", "lot", "new_lot").agg(F.sum(described_).alias("described"), F.sum("meet").alias("met"))
    best = Window.partitionBy("doc", "lot").orderBy(F.desc("described"), F.desc("met"), "new_lot")
    lots = shared.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("doc", "lot", "new_lot")
    same = old.join(lots, ["doc", "lot"]).join(n, ["doc", "cls", "new_lot"]).withColumns({"meet": meet, "equal": F.col("text") == F.col("new_text")})
    near = F.col("meet") >= share * F.least(F.col("stop") - F.col("start"), F.col("new_stop") - F.col("new_start"))
    told = same.withColumn("near", near & (F.col("meet") > 0))
    # texts are scored only where they differ: a null has no score
    differ, close = ~F.col("equal"), F.coalesce("near", F.lit(False))
    partly_, wholly_ = partial_ratio(F.when(differ & close, F.col("text")), "new_text"), ratio(F.when(differ & ~close, F.col("text")), "new_text")
    told = told.withColumn("alike", F.when(F.col("equal"), True).when(differ, F.when(close, partly_ >= partly).otherwise(wholly_ >= wholly)))
    order = Window.partitionBy("doc", "id").orderBy(F.desc("near"), F.abs(F.col("start") - F.col("new_start")), "new_id")
    found = told.where("alike").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc", "id", F.col("new_id").cast("string").alias("anchor"))
    return old.select("doc", "id").join(found, ["doc", "id"], "left").withColumn("anchor", F.coalesce("anchor", F.concat(F.lit("orphaned:"), F.col("id").cast("string"))))


def gold_scores(gold: DataFrame, found: DataFrame, fields: list[str], stratum: str) -> DataFrame:
    """Per stratum and field: gold values, values found, right ones, precision and recall.

    Both: doc, lot, reserve, ident and the fields; gold has the stratum too. A
    gold lot is the found one of its reserve, by the identifier where several
    have it, else the first. Values agree folded to letters and digits if equal
    or one holds the other; an empty gold value is never right.
    """
    f = found.select("doc", F.col("reserve"), F.col("lot").alias("f_lot"), F.col("ident").alias("f_ident"), *[F.col(c).alias(f"f_{c}") for c in fields])
    order = Window.partitionBy("doc", "lot").orderBy(F.desc(F.coalesce(F.col("ident") == F.col("f_ident"), F.lit(False))), "f_lot")
    paired = gold.join(f, ["doc", "reserve"], "left").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    fold = lambda c: F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", "")
    rows = paired.select(stratum, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), fold(F.col(c)).alias("g"), fold(F.col(f"f_{c}")).alias("f")) for c in fields])).alias("v")).select(stratum, "v.*")
    right = (F.col("g") != "") & (F.col("f") != "") & (F.col("g").contains(F.col("f")) | F.col("f").contains(F.col("g")))
    out = rows.groupBy(stratum, "field").agg(F.count(F.when(F.col("g") != "", 1)).alias("gold"), F.count(F.when(F.col("f") != "", 1)).alias("found"), F.count(F.when(right, 1)).alias("right"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("right") / F.col(n), 4))
    return out.withColumns({"precision": share("found"), "recall": share("gold")})


def disagreements(gold: DataFrame, found: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Lots paired on ``by``, each once in order, with the fields that agree and those to ask about; unpaired ones are questions whole."""

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return rows.select(*by, n.alias("_n"), F.col(order).alias(f"{side}_{order}"), *[F.col(c).alias(f"{side}_{c}") for c in fields])

    both = numbered(gold, "gold").join(numbered(found, "found"), [*by, "_n"], "full")
    same = {c: F.col(f"gold_{c}").eqNullSafe(F.col(f"found_{c}")) for c in fields}
    listed = lambda cases: F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in cases.items()])), ",")
    missing = F.when(F.col(f"found_{order}").isNull(), "not_found").when(F.col(f"gold_{order}").isNull(), "not_gold")
    agreed, asked = F.when(missing.isNull(), listed(same)).otherwise(""), F.coalesce(missing, listed({n: ~c for n, c in same.items()}))
    return both.select(*by, f"gold_{order}", f"found_{order}", agreed.alias("agreed"), asked.alias("questions"))


def shadow_counts(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two readers for each key, side by side, with the difference and its sense."""
    a, b = one.groupBy(*by).agg(F.count("*").alias("first")), two.groupBy(*by).agg(F.count("*").alias("second"))
    both = a.join(b, by, "full").na.fill(0, ["first", "second"]).withColumn("change", F.col("second") - F.col("first"))
    return both.withColumn("verdict", F.when(F.col("change") > 0, "more").when(F.col("change") < 0, "fewer").otherwise("same"))


def merged_by_rulings(groups: DataFrame, proposals: DataFrame, rulings: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """(groups after approved merges, proposals left).

    groups: id, n, label; proposals and rulings: a, b; rulings: approved too.
    Approved pairs join transitively, counts add up, the label is that of the
    largest group (then the longest, then by name). Any ruling, either way round
    and either way decided, takes its proposal away.
    """
    joined = components(rulings.where("approved").select("a", "b"), store)
    root = groups.join(joined, "id", "left").withColumn("id", F.coalesce("component", "id"))
    best = F.max_by("label", F.struct("n", F.length("label"), F.transform(F.split("label", ""), lambda c: -F.ascii(c))))
    after = root.groupBy("id").agg(F.sum("n").alias("n"), best.alias("label"), F.count("*").alias("members"))
    ruled = rulings.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    left = proposals.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(ruled, ["x", "y"], "left_anti").select("a", "b")
    return after, left


def lot_by_price_or_name(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """(listing, lot, how): the one lot of a listing's notice with its reserve; of several that with its borrower too; else the one with its borrower.

    listings: doc, listing, reserve, borrower; lots: doc, lot, reserve, borrower.
    Where no step leaves exactly one, lot is null and how says why.
    """
    t = lots.select("doc", "lot", F.col("reserve").alias("r"), F.col("borrower").alias("b"))
    both = listings.join(t, "doc", "left")
    price, name = F.col("reserve") == F.col("r"), F.col("borrower") == F.col("b")
    one = lambda c, n: (F.count(F.when(c, 1)).alias(f"n_{n}"), F.min(F.when(c, F.col("lot"))).alias(f"lot_{n}"))
    counted = both.groupBy("doc", "listing").agg(*one(price, "price"), *one(price & name, "both"), *one(name, "name"))
    how = F.when(F.col("n_price") == 1, "reserve").when(F.col("n_both") == 1, "reserve_borrower").when((F.col("n_price") == 0) & (F.col("n_name") == 1), "borrower")
    why = F.when((F.col("n_price") > 1) | (F.col("n_name") > 1), "ambiguous").otherwise("none")
    lot = F.when(how == "reserve", F.col("lot_price")).when(how == "reserve_borrower", F.col("lot_both")).when(how == "borrower", F.col("lot_name"))
    return counted.select("doc", "listing", lot.alias("lot"), F.coalesce(how, why).alias("how"))


def in_text_order(parts: DataFrame, texts: DataFrame, key: str, value: str) -> DataFrame:
    """Parts numbered by where their value first stands in the text of their key; those that don't stand in it last, by value."""
    at = F.nullif(F.instr(F.lower("text"), F.lower(F.col(value))), F.lit(0))
    placed = parts.join(texts, key).select(key, value, at.alias("at"))
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").asc_nulls_last(), value)))


def carousel(rows: DataFrame, group: str, when: str, value: str, key: str, as_of: Column, days: int, least: int, most: int) -> DataFrame:
    """Of what falls due within ``days``, groups with ``least`` rows or more: their ``most`` next ones, groups with the nearest first."""
    due = rows.where((F.col(when) >= as_of) & (F.col(when) < as_of + F.expr(f"INTERVAL {days} DAYS")))
    order = Window.partitionBy(group).orderBy(when, F.desc(value), key)
    held = due.withColumns({"slide": F.row_number().over(order), "in_group": F.count("*").over(Window.partitionBy(group))}).where(F.col("in_group") >= least)
    return held.where(F.col("slide") <= most).select(group, key, when, "slide", "in_group")


def top_replies(posts: DataFrame, replies: DataFrame, key: str, likes: str, reply: str, n: int) -> DataFrame:
    """Posts with their ``n`` most liked replies as an array of structs, best first; a post without replies has an empty one."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(likes), reply)
    top = replies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", reply, likes))).alias("replies"))
    return posts.join(lists, key, "left").withColumn("replies", F.coalesce("replies", F.array().cast(dict(lists.dtypes)["replies"])))


# Titles that stand before names.
_TITLES = ["mr", "mrs", "ms", "m/s", "shri", "sri", "smt", "thiru", "tmt", "selvi", "dr", "late"]


def name_words(name: Column) -> Column:
    """Words of a name that tell it apart: three letters or more, without titles."""
    w = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9/]+"), lambda x: ~x.isin(_TITLES))
    return F.array_distinct(F.filter(F.flatten(F.transform(w, lambda x: F.split(x, "/"))), lambda x: F.length(x) >= 3))


def names_meet(a: Column, b: Column) -> Column:
    """Whether a word of one array equals one of the other, or holds it and both have four letters or more."""
    long_ = lambda x, y: (F.length(x) >= 4) & (F.length(y) >= 4) & (x.contains(y) | y.contains(x))
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | long_(x, y)))


def id_words(text: Column) -> Column:
    """Numbers that identify land: measures carry ``sz:``, so that they never equal survey numbers; years and numbers of six digits or more are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sizes = F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d+(?:\.\d+)?)\s*(?:sq\.?\s*(?:ft|m)|cents?|acres?|hectares?|ares?)\b"), F.lit(1)), lambda x: F.concat(F.lit("sz:"), x))
    bare = F.regexp_replace(low, r"\b\d+(?:\.\d+)?\s*(?:sq\.?\s*(?:ft|m)|cents?|acres?|hectares?|ares?)\b", " ")
    ids = F.regexp_extract_all(bare, F.lit(r"\b(\d+(?:/\d+)*[a-z]?\d*)\b"), F.lit(1))
    kept = F.filter(ids, lambda x: ~x.rlike(r"^(?:19|20)\d\d$") & ~x.rlike(r"^\d{6,}"))
    return F.array_distinct(F.concat(sizes, kept))


def amount_grounds(said: Column, seen: Column) -> Column:
    """How an amount in an answer stands to those that were seen: equal, rounded (at 1 to 4 significant figures), near (half a percent, 1 at least), or loose."""

    def figures(x: Column, n: int) -> Column:
        scale = F.pow(F.lit(10.0), F.lit(n - 1.0) - F.floor(F.log10(x)))
        return F.round(F.round(x * scale) / scale, 6)

    rounded = F.exists(seen, lambda s: (s > 0) & (said > 0) & reduce(lambda a, b: a | b, [figures(s, n) == said for n in (1, 2, 3, 4)]))
    near = F.exists(seen, lambda s: F.abs(s - said) <= F.greatest(F.lit(1.0), 0.005 * s))
    return F.when(F.array_contains(seen, said), "equal").when(rounded, "rounded").when(near, "near").otherwise("loose")


def label_values(html: str) -> Column:
    """(label, value) pairs of a page: rows of just two table cells, then terms of definition lists; tags and doubled blanks gone, a label without its colon."""
    h = F.coalesce(F.col(html), F.lit(""))
    cell, term = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", r"(?is)<dt\b[^>]*>(.*?)</dt\s*>\s*<dd\b[^>]*>(.*?)</dd\s*>"
    plain = lambda x: F.trim(F.regexp_replace(F.replace(F.regexp_replace(x, r"<[^>]*>", " "), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    pair = lambda a, b: F.struct(F.regexp_replace(plain(a), r"\s*:$", "").alias("label"), plain(b).alias("value"))
    cells = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<tr\b[^>]*>.*?</tr\s*>"), F.lit(0)), lambda r: F.regexp_extract_all(r, F.lit(cell), F.lit(1)))
    rows = F.transform(F.filter(cells, lambda c: F.size(c) == 2), lambda c: pair(c[0], c[1]))
    terms = F.transform(F.regexp_extract_all(h, F.lit(term), F.lit(0)), lambda d: pair(F.regexp_extract(d, term, 1), F.regexp_extract(d, term, 2)))
    return F.filter(F.concat(rows, terms), lambda p: p["label"] != "")
