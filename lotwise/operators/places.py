"""Places of notices against a register of districts, taluks and villages.

The register is a gazetteer, small beside the notices. Every step looks up
distinct names once, by equal keys; near names meet by scope and length, which
loses none that is near enough, and a step answers only where it has one answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import places as P
from ..functions.similarity import ratio
from ..sources.scratch import stored

# How near a spelling must be, by how much it must lead, and the same for sounds.
SPELT, SPELT_LEAD = 90.0, 4.0
HEARD, HEARD_LEAD = 95.0, 12.0
SAME_SOUND = 90.0
MOST_PARTS = 4
COMPOUND = r"[-/,&]| and "


#: Letters that count as one where names are compared by their letters; each group's count, up to four, has four bits.
_GROUPS = ["a", "eiy", "ou", "b", "d", "gkqcx", "l", "m", "n", "pf", "r", "sz", "t", "vw", "hj", "0123456789"]
#: Parts that the names of one scope and length are dealt to.
_FAN = 24


def _tasks(rows: DataFrame) -> int:
    """Tasks for few rows that take long, which by their bytes alone would come to one task."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _letters(k: str) -> Column:
    """A name's letters as 64 bits, so that two names differ in no more bits than letters are added to or taken from one to make the other."""
    counts = [F.least(F.length(k) - F.length(F.translate(k, g, "")), F.lit(4)) for g in _GROUPS]
    bits = [F.array(*[F.lit((1 << c) - 1 << 4 * i).cast("long") if (1 << c) - 1 << 4 * i < 1 << 63 else F.lit(((1 << c) - 1 << 4 * i) - (1 << 64)) for c in range(5)])[n] for i, n in enumerate(counts)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def close(asked: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """Pairs of ``asked`` (scope, k) and ``pool`` (scope, key, answer) of one scope with a ratio of ``least`` or more, and their score.

    A ratio r needs lengths within r : (200 - r), so names meet on scope and length,
    dealt by the asked name; and letters that differ are at most (100 - r) % of both
    lengths, so that only pairs with so few are scored.
    """
    narrow = least / (200 - least)
    n, both = F.length("k"), F.length("k") + F.length("key")
    lengths = F.sequence(F.ceil(n * narrow).cast("int"), F.floor(n / narrow).cast("int"))
    names = asked.where(n > 0).withColumns({"_to": F.pmod(F.xxhash64("k"), F.lit(_FAN)).cast("int"), "_l": _letters("k")}).withColumn("_n", F.explode(lengths))
    dealt = pool.withColumns({"_n": F.length("key"), "_m": _letters("key")}).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1))))
    # a rounding error of the score's must not lose a pair
    by = ["scope", "_n", "_to"]
    pairs = names.repartition(_tasks(asked), *by).join(dealt.repartition(_tasks(asked), *by), by).where(100 * F.bit_count(F.col("_l").bitwiseXOR(F.col("_m"))) <= (100 - least) * both + 1e-6)
    return pairs.withColumn("score", ratio("k", "key")).where(F.col("score") >= least).drop("_n", "_to", "_l", "_m")


def nearest(asked: DataFrame, pool: DataFrame, floor: float = SPELT, lead: float = SPELT_LEAD) -> DataFrame:
    """(scope, k, near): the answer of the nearest key, if it is near enough, leads every other answer, and begins and counts alike."""
    by = Window.partitionBy("scope", "k")
    best = F.max(F.struct("score", "key", "answer")).over(by)
    pairs = close(asked.select("scope", "k").distinct(), pool, floor - lead).withColumn("_best", best)
    other = F.max(F.when(~F.col("answer").eqNullSafe(F.col("_best.answer")), F.col("score")))
    found = pairs.groupBy("scope", "k", "_best").agg(other.alias("_other"))
    fit = (F.col("_best.score") >= floor) & (F.substring("k", 1, 1) == F.substring("_best.key", 1, 1)) & (P.digits(F.col("k")) == P.digits(F.col("_best.key"))) & (F.col("_best.score") - F.coalesce("_other", F.lit(0.0)) >= lead)
    return found.where(fit).select("scope", "k", F.col("_best.answer").alias("near"))


def once_each(rows: DataFrame, name: str, keys: dict[str, Column]) -> DataFrame:
    """A row for each value of ``name`` with ``keys``, which speak of _said.

    The keys take some dozen patterns; as an aggregate's result _said keeps
    filters on them from being run on all rows before these are made distinct.
    """
    names = rows.where(F.col(name).isNotNull()).select(name).distinct().repartition(_tasks(rows), name)
    return names.groupBy(name).agg(F.max(name).alias("_said")).select(name, *[c.alias(k) for k, c in keys.items()])


def with_keys(rows: DataFrame, keys: dict[str, dict[str, Column]]) -> DataFrame:
    """Rows with the keys of each name, made once for each value; null where it is null. ``rows`` are read once more for each name."""
    return reduce(lambda out, name: out.join(once_each(rows, name, keys[name]), name, "left"), keys, rows)


def _named(names: DataFrame, pool: DataFrame) -> DataFrame:
    """(raw, hit) of distinct ``names`` (raw): the answer of the equal key, else of the nearest one. ``pool`` has one answer a key."""
    keyed = once_each(names, "raw", {"k": P.place_key(F.col("_said"))}).where("k IS NOT NULL")
    exact = keyed.join(pool.withColumnRenamed("key", "k"), "k", "left")
    near = nearest(exact.where("answer IS NULL").select(F.lit("").alias("scope"), "k"), pool.withColumn("scope", F.lit("")))
    return exact.join(near.drop("scope"), "k", "left").select("raw", F.coalesce("answer", "near").alias("hit")).where("hit IS NOT NULL")


def _heard(asked: DataFrame, spoken: DataFrame) -> DataFrame:
    """(scope, village, heard) of ``asked`` (scope, village): the register's name that sounds alike and leads all that sound otherwise."""
    names = asked.select("scope", "village", P.sound_key(F.col("village")).alias("k")).where("k IS NOT NULL").distinct()
    pairs = close(names, spoken, HEARD - HEARD_LEAD)
    by = Window.partitionBy("scope", "village")
    pairs = pairs.withColumn("_best", F.max(F.when(F.col("is_spoken"), F.struct("score", "answer"))).over(by)).withColumn("_sound", P.sound_key(F.col("_best.answer")))
    rival = (F.col("answer") != F.col("_best.answer")) & (ratio("compared", "_sound") < SAME_SOUND)
    found = pairs.groupBy("scope", "village", "k", "_best", "_sound").agg(F.max(F.when(rival, F.col("score"))).alias("_rival"))
    fit = (F.col("_best.score") >= HEARD) & (F.col("_best.score") - F.coalesce("_rival", F.lit(0.0)) >= HEARD_LEAD) & (F.substring("k", 1, 1) == F.substring("_sound", 1, 1)) & (P.sub_numbers(F.col("village")) == P.sub_numbers(F.col("_best.answer")))
    return found.where(fit).select("scope", "village", F.col("_best.answer").alias("heard"))


def _same(a: str, b: Column) -> Column:
    return F.col(a).eqNullSafe(b)


def village_keys(name: Column) -> dict[str, Column]:
    """What :func:`resolved_villages` reads of a village's name: its key, numbers and part."""
    return {"_k": P.place_key(name), "_numbers": P.sub_numbers(name), "_part": P.part(name)[1]}


def resolved_places(notices: DataFrame, register: DataFrame, key: str, other_states: list[str], other_districts: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Where each notice lies: key, district, taluk, village, parts, district_source, village_source, village_status, conflict.

    ``notices`` has key, state, district, taluk, village and registration, any of
    them null; ``register`` has district, taluk, village (null for a taluk without)
    and spoken (the name as it is said, in Latin letters, or null). The taluk goes first and brings its
    district, then a compound taluk, the district, a district in the taluk's field,
    the registration district. A village is looked up in its taluk, then in its
    district, without either in the whole register. What two places could be is
    none. Rows that repeat the key are each resolved; empty tables give empty ones.
    """
    names = F.create_map(*(F.lit(x) for pair in (aliases or {}).items() for x in pair)) if aliases else None
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    renamed = lambda c: given(c) if names is None else F.coalesce(F.try_element_at(names, plain(c)), given(c))
    rows = notices.select(key, plain("state").alias("_state"), plain("district").alias("_dname"), renamed("district").alias("_d"), renamed("taluk").alias("_t"), given("village").alias("_v"), renamed("registration").alias("_r"))

    villages = once_each(rows, "_v", village_keys(F.col("_said")))

    taluks = register.select("district", "taluk").distinct().withColumn("key", P.place_key(F.col("taluk"))).where("key IS NOT NULL")
    one_taluk = taluks.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("taluk", "district")).alias("answer")).where("n = 1").drop("n")
    one_district = register.select(F.col("district").alias("answer")).distinct().withColumn("key", P.place_key(F.col("answer"))).groupBy("key").agg(F.min("answer").alias("answer")).where("key IS NOT NULL")

    # names of taluks and districts, halves of compound ones included
    half = F.posexplode(F.split("_t", COMPOUND)).alias("at", "piece")
    halves = rows.select("_t").distinct().where(F.size(F.filter(F.split("_t", COMPOUND), lambda x: F.trim(x) != "")) > 1).select("_t", half).withColumn("piece", F.trim("piece"))
    now = r"(?i)^(now|new)\s+"
    halves = halves.select("_t", "at", "piece", F.when(F.col("piece").rlike(now), F.regexp_replace("piece", now, "")).alias("current"))
    taluk_names = rows.select(F.col("_t").alias("raw")).union(rows.select("_r")).union(halves.select("piece")).union(halves.select("current"))
    taluk_of = stored(_named(taluk_names, one_taluk), "taluks")
    district_of = stored(_named(rows.select(F.col("_d").alias("raw")).union(rows.select("_t")).union(rows.select("_r")), one_district), "districts")

    def looked(df: DataFrame, table: DataFrame, c: str, to: str) -> DataFrame:
        return df.join(table.toDF(c, to), c, "left")

    both = looked(looked(halves, taluk_of, "piece", "hit"), taluk_of, "current", "current_hit")
    compound = both.groupBy("_t").agg(F.min(F.when(F.col("current_hit").isNotNull(), F.struct("at", F.col("current_hit").alias("hit"))))["hit"].alias("current"), F.collect_set("hit").alias("hits"))
    compound = compound.select("_t", F.coalesce("current", F.when(F.size("hits") == 1, F.col("hits")[0])).alias("_pair"), F.when(F.size(F.array_distinct(F.transform("hits", lambda h: h["district"]))) == 1, F.col("hits")[0]["district"]).alias("_shared"))

    rows = looked(rows, taluk_of, "_t", "_own").join(compound, "_t", "left")
    rows = looked(looked(looked(looked(rows, district_of, "_d", "_stated"), district_of, "_t", "_from_taluk"), district_of, "_r", "_from_office"), taluk_of, "_r", "_office")
    hit = F.coalesce("_own", "_pair")
    sources = [(hit["district"], "taluk"), (F.col("_stated"), "district"), (F.when(F.col("_own").isNull(), F.col("_shared")), "compound-taluk-field"), (F.col("_from_taluk"), "taluk-field-names-a-district"), (F.col("_from_office"), "registration-district"), (F.col("_office.district"), "registration-district-names-a-taluk")]
    rows = rows.select(
        key, "_v",
        (F.coalesce(F.col("_state").isin(other_states), F.lit(False)) | (F.col("_stated").isNull() & F.coalesce(F.col("_dname").isin(other_districts), F.lit(False)))).alias("_outside"),
        hit["taluk"].alias("taluk"), F.coalesce(*[c for c, _ in sources]).alias("district"), F.coalesce(*[F.when(c.isNotNull(), n) for c, n in sources]).alias("district_source"),
        F.coalesce(F.col("_stated") != hit["district"], F.lit(False)).alias("conflict"),
    )
    return resolved_villages(stored(rows.join(villages, "_v", "left"), "placed"), register, key)


def resolved_villages(rows: DataFrame, register: DataFrame, key: str, anywhere: bool = True) -> DataFrame:
    """The second half of the ladder: the village of rows whose taluk and district are settled or null.

    ``rows`` has the key, the name as ``_v`` and what :func:`village_keys` gives, ``_outside``,
    district, taluk, district_source and conflict, and is read several times, so
    store it before. Without ``anywhere`` no row lacks both, and the step that
    looks in the whole register is left out.
    """
    v = register.select("district", "taluk", "village", "spoken", P.place_key(F.col("village")).alias("key"))
    taluks = register.select("district", "taluk").distinct().withColumn("key", P.place_key(F.col("taluk"))).where("key IS NOT NULL")
    # villages by taluk, by part, by district and in the whole register
    keyed = v.where("key IS NOT NULL")
    in_taluk = keyed.groupBy("taluk", "district", "key").agg(F.count("*").alias("n"), F.min("village").alias("one")).withColumn("one", F.when(F.col("n") == 1, F.col("one")))
    scope = F.concat_ws("\t", "district", "taluk")
    pool = in_taluk.select(scope.alias("scope"), "key", F.col("one").alias("answer"))
    whole, which = P.part(F.col("village"))
    split = keyed.withColumn("_whole", P.place_key(whole)).withColumn("_which", which).join(in_taluk.select("taluk", "district", "key", "n"), ["taluk", "district", "key"])
    split = split.where("_whole IS NOT NULL").groupBy("taluk", "district", F.col("_whole").alias("_k")).agg(F.countDistinct("_which").alias("_wholes"), F.max("n").alias("_most"), F.array_sort(F.collect_set("village")).alias("_parts")).where(F.col("_wholes").between(2, MOST_PARTS) & (F.col("_most") == 1)).drop("_wholes", "_most")
    wide = in_taluk.groupBy("district", "key").agg(F.count("*").alias("c"), F.min("taluk").alias("_wide_taluk"), F.min("one").alias("_wide")).where("c = 1 AND _wide IS NOT NULL").select("district", F.col("key").alias("_k"), "_wide_taluk", "_wide")
    if anywhere:
        by_name = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("district").alias("_sd"), F.min("taluk").alias("_st"), F.min("village").alias("_sv"), F.collect_set("district").alias("ds"))
        everywhere = by_name.select(F.lit("").alias("scope"), "key", F.col("ds").alias("answer"))
        lone = by_name.where("c = 1").select(F.col("key").alias("_k"), "_sd", "_st", "_sv")
        needed = rows.where("district IS NULL AND taluk IS NULL").select("_k").distinct().join(lone, "_k")
        twins = close(needed.select(F.lit("").alias("scope"), F.col("_k").alias("k"), "_sd"), everywhere, SPELT).where((F.col("k") != F.col("key")) & F.exists("answer", lambda d: d != F.col("_sd"))).select(F.col("k").alias("_k")).distinct()
        state = needed.join(twins, "_k", "left_anti").withColumnsRenamed({"_k": "_state_k"})
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("_sd", "_st", "_sv")})

    rows = rows.join(in_taluk.select("taluk", "district", F.col("key").alias("_k"), F.col("n").alias("_copies"), F.col("one").alias("_exact")), ["taluk", "district", "_k"], "left")
    rows = rows.join(split, ["taluk", "district", "_k"], "left").join(wide, ["district", "_k"], "left")
    if anywhere:
        rows = rows.join(state, _same("_k", F.col("_state_k")) & F.col("district").isNull() & F.col("_k").isNotNull(), "left").drop("_state_k")
    rows = rows.join(taluks.select("district", F.col("key").alias("_k"), F.lit(True).alias("_is_taluk")).distinct(), ["district", "_k"], "left")
    rows = rows.join(keyed.select("taluk", "district", F.lit(True).alias("_has_villages")).distinct(), ["taluk", "district"], "left")
    open_ = rows.where("_copies IS NULL AND taluk IS NOT NULL AND _k IS NOT NULL").select(scope.alias("scope"), F.col("_k").alias("k"), F.col("_v").alias("village")).distinct()
    near = nearest(open_, pool)
    sounds = v.select(scope.alias("scope"), F.explode(F.array(F.struct(F.col("spoken").alias("said"), F.lit(True).alias("is_spoken")), F.struct(F.col("village").alias("said"), F.lit(False).alias("is_spoken")))).alias("s"), "village").select("scope", P.sound_key(F.col("s.said")).alias("key"), F.col("village").alias("answer"), "s.is_spoken")
    sounds = sounds.where("key IS NOT NULL").withColumn("compared", F.when(F.col("is_spoken"), P.sound_key(F.col("answer"))).otherwise(F.col("key")))
    heard = _heard(open_, sounds).withColumnsRenamed({"village": "_v"})
    rows = rows.withColumn("scope", F.when(F.col("taluk").isNotNull(), scope))
    rows = rows.join(near.withColumnsRenamed({"k": "_k"}), ["scope", "_k"], "left").join(heard, ["scope", "_v"], "left")
    heard_ok = in_taluk.where("n > 1").select(scope.alias("scope"), F.col("key").alias("_hk"), F.lit(True).alias("_shared_sound"))
    rows = rows.withColumn("_hk", P.place_key(F.col("heard"))).join(heard_ok, ["scope", "_hk"], "left")

    own_name = F.coalesce(F.col("_k") == P.place_key(F.col("taluk")), F.lit(False))
    parts = F.when(F.col("_copies").isNull() & F.col("_part").isNull() & (F.col("_numbers") == ""), F.col("_parts"))
    resolved = "resolved"
    # the first step whose condition holds: (condition, status, source, village, taluk, district)
    here, there = (F.col("taluk"), F.col("district")), (F.col("_wide_taluk"), F.col("district"))
    none = F.lit(None).cast("string")
    steps = [
        (F.col("_outside"), "outside-state", none, none, none, none),
        (F.col("_v").isNull(), "absent", none, none, *here),
        (F.col("taluk").isNull() & F.col("_sv").isNotNull(), resolved, F.lit("state"), F.col("_sv"), F.col("_st"), F.col("_sd")),
        (F.col("taluk").isNull(), "no-parent-taluk", none, none, *here),
        (F.col("_exact").isNotNull(), resolved, F.lit("taluk"), F.col("_exact"), *here),
        (own_name, "names-a-taluk", none, none, *here),
        (parts.isNotNull(), "one-of-parts", F.lit("split-village"), none, *here),
        (F.col("near").isNotNull(), resolved, F.lit("taluk"), F.col("near"), *here),
        (F.col("_wide").isNotNull(), resolved, F.lit("district"), F.col("_wide"), *there),
        (F.coalesce("_is_taluk", F.lit(False)), "names-a-taluk", none, none, *here),
        (F.col("heard").isNotNull() & F.col("_shared_sound").isNull(), resolved, F.lit("sound"), F.col("heard"), *here),
        (F.col("_has_villages").isNull(), "taluk-has-no-villages", none, none, *here),
        (F.lit(True), "unmatched", none, none, *here),
    ]
    step = F.coalesce(*[F.when(c, F.struct(F.lit(status).alias("status"), source.alias("source"), village.alias("village"), taluk.alias("taluk"), district.alias("district"))) for c, status, source, village, taluk, district in steps])
    source = F.when(F.col("_outside"), None).when(F.col("s.source") == "state", "village").otherwise(F.col("district_source"))
    out = rows.withColumn("s", step).withColumn("_p", parts)
    return out.select(
        key, F.col("s.district").alias("district"), F.col("s.taluk").alias("taluk"), F.col("s.village").alias("village"), F.when(F.col("s.status") == "one-of-parts", F.array_join("_p", ",")).alias("parts"),
        source.alias("district_source"), F.col("s.source").alias("village_source"), F.col("s.status").alias("village_status"), (F.col("conflict") & ~F.col("_outside")).alias("conflict"),
    )
