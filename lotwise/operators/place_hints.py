"""Places of notices that the ladder leaves open, by what else a notice says.

Every hint proposes taluks, and one run of the ladder's second half over
the distinct proposals tells which of them hold the village. A hint whose proposals lead to
two places is none; the first hint in :data:`ORDER` that leads to one counts.
What is placed teaches offices, PIN codes and neighbours for the next round.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..sources.scratch import stored
from .analytics import majority
from .places import _named, close, nearest, resolved_villages, village_keys, with_keys

# Hints by the order in which they are believed.
ORDER = ["village-pieces", "taluk", "district-sound", "district-fuzzy", "neighbour-taluk", "census-2011", "metro-unique", "gram-panchayat", "habitation", "lgd-town"]
# The hints that name a taluk, by the order in which they lend their name; they cancel one another.
TALUK_HINTS = ["sro-taluk", "city-taluk", "pin-taluk"]
# How near a spelling must be in a district, and how near another name of the metropolis may be.
DISTRICT_SPELT, METRO_TWIN = 91.0, 85.0
# How many placed notices a learned hint needs, and their share.
LEARNED_FROM, LEARNED_SHARE = 3, 0.9
# Words of a registration office, of a city, and of villages and localities in a field with several names.
OFFICE_WORDS = ["sub", "sro", "office", "registration", "district", "joint", "no"]
CITY_WORDS = ["town", "city", "taluk", "tk", "district", "dist"]
PIECE_WORDS = ["group", "town", "municipal", "municipality", "natham", "limit", "limits", "now"]
LOCALITY_WORDS = ["ward", "street", "road", "nagar", "colony", "layout", "extension"]
# Words that call a name a town, what then speaks of a planning office, and local bodies that are no gram panchayat.
TOWN_WORDS = ["town", "municipality", "municipal", "corporation", "tp", "township"]
PLANNING = ["and country", "planning", "and planning"]
OTHER_BODIES = r"(?i)\b(union|town|municipal\w*|corporation)\b"
LONGEST_TOWN = 3

_OPEN = ["no-parent-taluk", "unmatched"]


@dataclass(frozen=True)
class Hints:
    """Tables that hints go by; a table that is missing has no say.

    ``offices`` (office, taluk), ``pins`` (pin, taluk), ``neighbours`` (taluk,
    other), ``panchayats`` (taluk, panchayat, village), ``hamlets`` (code, hamlet,
    taluk, village), ``lineage`` (old, village, taluk, now: an earlier taluk, a
    village of it or null, its taluk and name of today), ``towns`` (town, kind,
    district, taluk: a row for each taluk). Taluks and districts are named as in
    the register. ``metro`` are districts in which a name that is there once
    decides, ``core`` the taluks where it may lie.
    """

    offices: DataFrame | None = None
    pins: DataFrame | None = None
    neighbours: DataFrame | None = None
    panchayats: DataFrame | None = None
    hamlets: DataFrame | None = None
    lineage: DataFrame | None = None
    towns: DataFrame | None = None
    metro: tuple[str, ...] = ()
    core: tuple[str, ...] = ()


def _words_but(text: Column, words: list[str]) -> Column:
    """A text without some words and the spaces and marks at its ends."""
    rest = F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(words)})\b\.?", " ")
    return F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ .'-]+|[ .'-]+$", "")


def office_key(name: Column) -> Column:
    """One key for the spellings of a registration office: its town by sound; null without one."""
    words = F.split(F.regexp_replace(F.lower(F.replace(name, F.lit("."), F.lit(""))), "[^a-z0-9]+", " "), " ")
    town = F.filter(words, lambda w: ~w.isin(OFFICE_WORDS) & ~w.startswith("registr") & ~w.rlike("^([0-9]+|[ivx]+)$"))
    return P.sound_key(P.place_key(F.array_join(town, " ")))


def village_pieces(village: Column) -> Column:
    """The names in a village field that holds more than one plain name, without localities; else an empty array. "A hamlet of B" is B."""
    parts = F.split(F.regexp_replace(village, r"(?is)^.*\bhamlet\s+of\b", " "), r"[,;/&@()]|(?i:\band\b)")
    named = F.filter(parts, lambda p: ~p.rlike(rf"(?i)\b({'|'.join(LOCALITY_WORDS)})\b"))
    kept = F.filter(F.transform(named, lambda p: _words_but(p, PIECE_WORDS)), lambda p: F.coalesce(F.length(P.place_key(p)) >= 3, F.lit(False)))
    plain = (F.size(kept) == 1) & (P.place_key(F.try_element_at(kept, F.lit(1))) == P.place_key(village))
    return F.when(plain | kept.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(kept))


def called_towns(text: Column) -> Column:
    """Keys of all names of up to three words that a word calls a town ("Attur Town", but not the "Town and Country Planning" office)."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1))
    low = F.transform(words, F.lower)
    after = lambda i: F.array_join(F.slice(low, i + 2, 2), " ")
    marked = lambda i: F.get(low, i).isin(TOWN_WORDS) & ~reduce(lambda a, p: a | after(i).startswith(p), PLANNING, F.lit(False)) & P.place_key(F.get(words, i - 1)).isNotNull()
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.coalesce(marked(i), F.lit(False)))
    names = F.flatten(F.transform(at, lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(LONGEST_TOWN)), lambda n: n <= i), lambda n: P.place_key(F.array_join(F.slice(words, i - n + 1, n), " ")))))
    return F.array_distinct(F.filter(names, lambda k: F.coalesce(F.length(k) >= 4, F.lit(False))))


def learned(placed: DataFrame, notices: DataFrame, key: str, register: DataFrame) -> Hints:
    """Offices, PIN codes and neighbours that placed notices teach.

    An office or PIN names a taluk where enough notices carry it and nearly all
    of them lie there; two taluks are neighbours, both ways, where enough notices
    name one and lie in the other.
    """
    lie = placed.where("village IS NOT NULL").select(key, F.col("taluk").alias("_lies"))
    said = with_keys(notices.select(key, "taluk", "registration", "pin"), {"registration": {"_office": office_key(F.col("_said"))}, "taluk": {"_k": P.place_key(F.col("_said"))}}).join(lie, key)
    taught = lambda value, name: majority(said.select(value.alias(name), F.col("_lies").alias("taluk")).where(F.col(name).isNotNull()), name, "taluk", LEARNED_FROM, LEARNED_SHARE).select(name, "taluk")
    names = register.groupBy(P.place_key(F.col("taluk")).alias("_k")).agg(F.min("taluk").alias("taluk"), F.countDistinct("taluk", "district").alias("_n")).where("_n = 1 AND _k IS NOT NULL")
    moved = said.select("_k", F.col("_lies").alias("other")).join(names, "_k").where("taluk <> other").groupBy("taluk", "other").count().where(F.col("count") >= LEARNED_FROM)
    both = moved.select("taluk", "other").union(moved.select("other", "taluk")).distinct()
    return Hints(offices=taught(F.col("_office"), "office"), pins=taught(F.col("pin"), "pin"), neighbours=both)


def _with(given: DataFrame | None, more: DataFrame, by: str) -> DataFrame:
    """Both tables; a value that they place in different taluks is believed by neither."""
    all_ = more if given is None else given.select(more.columns).union(more)
    return all_.groupBy(by).agg(F.min("taluk").alias("taluk"), F.countDistinct("taluk").alias("_n")).where("_n = 1").drop("_n")


def _once(df: DataFrame, by: list[str], answer: Column) -> DataFrame:
    """``by`` and the answer, where all rows of a group have the same one."""
    return df.groupBy(*by).agg(F.min(answer).alias("answer"), F.countDistinct(answer).alias("_n")).where("_n = 1").drop("_n")


def _proposals(open_: DataFrame, key: str, register: DataFrame, hints: Hints, again: bool) -> DataFrame:
    """(key, hint, label, tier, turn, needed, district, taluk, asked): where each hint would look for which name."""
    taluks = register.select("taluk", "district").distinct()
    one_taluk = _once(taluks.select(P.place_key(F.col("taluk")).alias("key"), F.struct("taluk", "district").alias("a")).where("key IS NOT NULL"), ["key"], F.col("a"))
    where = one_taluk.select(F.col("answer.taluk").alias("_to"), F.col("answer.district").alias("_in"))
    fits = (F.col("district").isNull() | (F.col("district") == F.col("_in"))) & ~F.col("_to").eqNullSafe(F.col("taluk"))

    def rows(df: DataFrame, hint: str, label: str, asked="village", tier=0, turn=0, needed=1) -> DataFrame:
        needed = needed if isinstance(needed, Column) else F.lit(needed)
        return df.select(key, F.lit(hint).alias("hint"), F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(turn).alias("turn"), needed.alias("needed"), F.col("_in").alias("district"), F.col("_to").alias("taluk"), F.col(asked).alias("asked"))

    unmatched = open_.where("village_status = 'unmatched' AND taluk IS NOT NULL")
    out = []
    pieces = unmatched.withColumn("_needed", F.size("_pieces")).withColumn("_piece", F.explode("_pieces")).withColumns({"_in": F.col("district"), "_to": F.col("taluk")})
    if not again:
        out.append(rows(pieces, "village-pieces", "village-pieces", "_piece", needed=F.col("_needed")))
    if hints.offices is not None:
        offices = hints.offices.select(F.col("office").alias("_office"), F.col("taluk").alias("_to"))
        out.append(rows(open_.join(offices, "_office").join(where, "_to").where(fits), "taluk", "sro-taluk"))
    if hints.pins is not None:
        out.append(rows(open_.join(hints.pins.select("pin", F.col("taluk").alias("_to")), "pin").join(where, "_to").where(fits), "taluk", "pin-taluk"))
    # the first name in the city's field that is a taluk of the known district
    cities = open_.select(key, "village", "district", "taluk", F.posexplode(F.split("city", "[,/;]")).alias("_at", "_raw")).withColumn("raw", _words_but(F.col("_raw"), CITY_WORDS)).where("length(raw) >= 4")
    named = _named(cities.select("raw"), one_taluk)
    hit = cities.join(named, "raw").where(F.col("district").isNull() | (F.col("hit.district") == F.col("district")))
    first = hit.groupBy(key, "village", "district", "taluk").agg(F.min_by("hit", "_at").alias("_h")).withColumns({"_to": F.col("_h.taluk"), "_in": F.col("_h.district")})
    out.append(rows(first.where(fits), "taluk", "city-taluk"))
    if hints.neighbours is not None:
        near = hints.neighbours.select("taluk", F.col("other").alias("_to")).distinct()
        out.append(rows(unmatched.join(near, "taluk").join(where, "_to").where(fits), "neighbour-taluk", "neighbour-taluk"))
    if hints.lineage is not None and not again:
        known = hints.lineage.select("old", P.place_key(F.col("old")).alias("_old"), P.place_key(F.col("village")).alias("_moved"), F.col("taluk").alias("_to"), "now").join(where, "_to")
        asked = open_.withColumn("_t", F.col("_taluk_key")).where("_t IS NOT NULL")
        whole = known.select("old", "_old", "_in").distinct()
        halves = whole.select("old", "_in", F.regexp_extract("_old", "^(.+)(nort|sout|east|west)$", 1).alias("_t")).where("_t <> ''")
        halves = halves.join(whole.select(F.col("_old").alias("_t")), "_t", "left_anti")
        spelt = whole.withColumnRenamed("_old", "_t").unionByName(halves).groupBy("_t").agg(F.collect_set(F.struct("old", "_in")).alias("_olds"))
        # of several earlier taluks of one spelling those with a village in the known district
        olds = asked.join(spelt, "_t").withColumn("_o", F.explode("_olds"))
        several = F.size(F.array_distinct(F.transform("_olds", lambda o: o["old"]))) > 1
        olds = olds.where(F.col("district").isNull() | ~several | (F.col("_o._in") == F.col("district"))).withColumn("old", F.col("_o.old")).drop("_olds", "_o", "_t").distinct()
        fits_now = F.col("district").isNull() | (F.col("district") == F.col("_in"))
        moved = olds.withColumn("_moved", F.col("_village_key")).join(known.drop("_old"), ["old", "_moved"]).where(fits_now)
        out += [rows(moved, "census-2011", "census-2011"), rows(moved.where("now IS NOT NULL"), "census-2011", "census-2011", "now", turn=1)]
        out.append(rows(olds.join(known.select("old", "_to", "_in").distinct(), "old").where(fits_now), "census-2011", "census-2011", tier=1))
    return reduce(DataFrame.unionByName, out)


def _towns(open_: DataFrame, key: str, towns: DataFrame) -> DataFrame:
    """(key, town, kind, town_district, only_taluk) of rows whose text calls just one town so that fits what is known."""
    known = towns.groupBy("town", "kind", "district").agg(F.collect_set("taluk").alias("_taluks")).select("town", "kind", F.col("district").alias("_td"), "_taluks", P.place_key(F.col("town")).alias("_key"))
    said = open_.select(key, F.col("district").alias("_d"), F.col("taluk").alias("_t"), F.explode(called_towns(F.col("text"))).alias("_key")).join(known, "_key")
    fit = (F.col("_d").isNull() | (F.col("_d") == F.col("_td"))) & (F.col("_t").isNull() | (F.size("_taluks") == 0) | F.array_contains("_taluks", F.col("_t")))
    one = _once(said.where(fit & F.col("_td").isNotNull()), [key], F.struct("town", "_td", "kind", "_taluks"))
    return one.select(key, "answer.town", F.col("answer.kind").alias("town_kind"), F.col("answer._td").alias("town_district"), F.when(F.size("answer._taluks") == 1, F.col("answer._taluks")[0]).alias("only_taluk"))


def _by_name(open_: DataFrame, key: str, register: DataFrame, v: DataFrame, lone: DataFrame, ct: DataFrame, hints: Hints) -> list[DataFrame]:
    """Answers that the register gives for the name alone: by sound, by spelling, in a metropolis, as a panchayat or hamlet."""
    none = F.lit(None).cast("string")
    answers = []

    def answer(df: DataFrame, hint: str) -> DataFrame:
        return df.select(key, F.lit(hint).alias("hint"), F.lit(hint).alias("source"), "district", "taluk", "village", (F.col("parts") if "parts" in df.columns else none).alias("parts"))

    # names by sound and by spelling in a district that doesn't hold them exactly
    homeless = open_.where("village_status = 'no-parent-taluk' AND district IS NOT NULL").select(key, "district", F.col("_village_sound").alias("_s"), F.col("_village_key").alias("key"), F.col("_village_shape").alias("_shape"))
    homeless = stored(homeless.where("key IS NOT NULL").join(v.select("district", "key").distinct(), ["district", "key"], "left_anti"), "homeless")
    shape = P.village_shape(F.col("village"))
    alone = lone.where("_n = 1").select("taluk", "district", "key", F.lit(True).alias("_alone"))
    heard = v.select("district", F.col("sound").alias("_s"), F.col("shape").alias("_shape2"), "village", "taluk").where("_s IS NOT NULL").distinct()
    by_sound = _once(homeless.join(heard, ["district", "_s"]).where(F.col("_shape").eqNullSafe(F.col("_shape2"))), [key, "district"], F.struct("village", "taluk"))
    by_sound = by_sound.select(key, "district", "answer.*").withColumn("key", P.place_key(F.col("village"))).join(alone, ["taluk", "district", "key"])
    answers.append(answer(by_sound, "district-sound"))
    pool = v.groupBy(F.col("district").alias("scope"), "key").agg(F.array_sort(F.collect_set(F.struct("village", "taluk"))).alias("answer"))
    spelt = nearest(homeless.select(F.col("district").alias("scope"), F.col("key").alias("k")), pool, floor=DISTRICT_SPELT).where("size(near) = 1")
    by_spelling = homeless.withColumnsRenamed({"key": "k"}).join(spelt.select(F.col("scope").alias("district"), "k", F.col("near")[0].alias("_near")), ["district", "k"]).select(key, "district", "_shape", "_near.*")
    by_spelling = by_spelling.where(F.col("_shape").eqNullSafe(shape)).withColumn("key", P.place_key(F.col("village"))).join(alone, ["taluk", "district", "key"])
    answers.append(answer(by_spelling, "district-fuzzy"))

    if hints.metro:
        there = v.where(F.col("district").isin(*hints.metro))
        unique = _once(there, ["key"], F.struct("village", "taluk", "district")).select("key", "answer.*").where(F.col("taluk").isin(*hints.core)).join(alone, ["taluk", "district", "key"])
        unique = unique.join(ct.select("taluk", F.col("_ct").alias("key")), ["taluk", "key"], "left_anti").join(register.where(F.col("district").isin(*hints.metro)).select(P.place_key(F.col("taluk")).alias("key")).distinct(), "key", "left_anti")
        asked = open_.where(F.col("district").isin(*hints.metro)).select(key, F.col("_village_key").alias("key")).join(unique, "key")
        other = close(asked.select(F.lit("").alias("scope"), F.col("key").alias("k")).distinct(), there.select(F.lit("").alias("scope"), "key", F.col("key").alias("answer")).distinct(), METRO_TWIN).where("k <> key").select(F.col("k").alias("key")).distinct()
        answers.append(answer(asked.join(other, "key", "left_anti"), "metro-unique"))

    def narrowed(table: DataFrame, named: DataFrame, hint: str) -> DataFrame:
        """One of the villages of a body: ``table`` (taluk, _k, _body, village), ``named`` (key, district, taluk, _k, _turn)."""
        bodies = table.where("_k IS NOT NULL").groupBy("taluk", "_k", "_body").agg(F.array_join(F.array_sort(F.collect_set("village")), ",").alias("parts"))
        bodies = bodies.join(register.select("taluk", "district").distinct(), "taluk").select(F.col("taluk").alias("_to"), F.col("district").alias("_in"), "_k", "parts")
        hit = named.where("_k IS NOT NULL").join(bodies, "_k").where(F.when(F.col("taluk").isNotNull(), F.col("taluk") == F.col("_to")).otherwise(F.col("district") == F.col("_in")))
        one = hit.groupBy(key, "_turn").agg(F.count("*").alias("_n"), F.min(F.struct("_to", "_in", "parts")).alias("a")).where("_n = 1").groupBy(key).agg(F.min_by("a", "_turn").alias("a"))
        return answer(one.select(key, F.col("a._in").alias("district"), F.col("a._to").alias("taluk"), none.alias("village"), "a.parts"), hint)

    body = lambda c, turn: open_.where(~F.col(c).rlike(OTHER_BODIES)).select(key, "district", "taluk", F.col(f"_{c}_key").alias("_k"), F.lit(turn).alias("_turn"))
    if hints.panchayats is not None:
        answers.append(narrowed(hints.panchayats.select("taluk", P.place_key(F.col("panchayat")).alias("_k"), F.lit("").alias("_body"), "village"), body("panchayat", 0).unionByName(body("village", 1)), "gram-panchayat"))
    if hints.hamlets is not None:
        answers.append(narrowed(hints.hamlets.select("taluk", P.place_key(F.col("hamlet")).alias("_k"), F.col("code").cast("string").alias("_body"), "village"), body("village", 0), "habitation"))
    return answers


def _one_round(rows: DataFrame, key: str, register: DataFrame, hints: Hints, again: bool) -> DataFrame:
    """Rows with what hints place. What a hint says of a row changes only with learned tables, so that a round
    ``again`` asks only those that go by them; to a row that is still open the others have said nothing."""
    open_ = stored(rows.where(F.col("village").isNull() & F.col("parts").isNull() & F.col("village_status").isin(_OPEN)).drop("village").withColumnRenamed("said_village", "village"), "open")
    v = register.where("key IS NOT NULL")
    lone = v.groupBy("taluk", "district", "key").agg(F.count("*").alias("_n"), F.min("village").alias("village"))
    ct = v.where(F.col("village").rlike(r"(?i)\(\s*ct\s*\)")).select("taluk", P.place_key(F.regexp_replace("village", r"(?i)\(\s*ct\s*\)", " ")).alias("_ct")).distinct()

    # where a hint names a taluk, the ladder runs inside it, once for each distinct question
    asks = _proposals(open_, key, register, hints, again)
    towns = None
    if hints.towns is not None and not again:
        towns = stored(_towns(rows.where(F.col("village").isNull() & F.col("parts").isNull() & (F.col("village_status") != "outside-state")), key, hints.towns), "towns")
        inside = open_.where("taluk IS NULL").select(key, "village").join(towns.where("only_taluk IS NOT NULL"), key)
        asks = asks.unionByName(inside.select(key, F.lit("lgd-town").alias("hint"), F.lit("lgd-town").alias("label"), F.lit(0).alias("tier"), F.lit(0).alias("turn"), F.lit(1).alias("needed"), F.col("town_district").alias("district"), F.col("only_taluk").alias("taluk"), F.col("village").alias("asked")))
    asks = stored(asks.where("asked IS NOT NULL"), "asks")
    question = F.struct("district", "taluk", "asked")
    distinct = asks.select(question.alias("_ask")).distinct()
    none = F.lit(None).cast("string")
    no = F.lit(False)
    inside = with_keys(distinct.withColumn("_v", F.col("_ask.asked")), {"_v": village_keys(F.col("_said"))}).select("_ask", "_v", "_k", "_numbers", "_part", no.alias("_outside"), "_ask.district", "_ask.taluk", none.alias("district_source"), no.alias("conflict"))
    tried = resolved_villages(stored(inside, "inside"), register, "_ask", anywhere=False)
    tried = tried.where((F.col("taluk") == F.col("_ask.taluk")) & (F.col("district") == F.col("_ask.district")) & (F.col("village").isNotNull() | F.col("parts").isNotNull()))
    tried = stored(tried.select(F.col("_ask.district").alias("district"), F.col("_ask.taluk").alias("taluk"), F.col("_ask.asked").alias("asked"), "village", "parts"), "tried")  # read twice
    # a census town of that name beside the village leaves the choice to a person
    names = tried.select("district", "taluk", "asked", F.explode(F.array_compact(F.concat(F.array("asked", "village"), F.coalesce(F.split("parts", ","), F.array())))).alias("_name"))
    twins = names.withColumn("_ct", P.place_key(F.regexp_replace("_name", r"(?i)\(\s*ct\s*\)", " "))).join(ct, ["taluk", "_ct"]).select("district", "taluk", "asked", F.lit(True).alias("_twin")).distinct()
    found = asks.join(tried, ["district", "taluk", "asked"]).join(twins, ["district", "taluk", "asked"], "left")
    # one answer a taluk: that of the first name tried there; only the first tier with answers
    in_taluk = found.where("hint <> 'village-pieces' OR village IS NOT NULL")
    whole = in_taluk.groupBy(key, "hint").agg(F.min("tier").alias("tier"))
    in_taluk = in_taluk.join(whole, [key, "hint", "tier"])
    best = in_taluk.groupBy(key, "hint", "district", "taluk", "needed").agg(F.min(F.struct("turn", "village", "parts")).alias("b"), F.countDistinct("village").alias("_answers"), F.countDistinct("asked").alias("_asked"), F.max(F.coalesce("_twin", F.lit(False))).alias("_twin"), F.collect_set("label").alias("_labels"))
    best = best.where((F.col("hint") != "village-pieces") | ((F.col("_asked") == F.col("needed")) & (F.col("_answers") == 1)))
    settled = best.groupBy(key, "hint").agg(
        F.count("*").alias("_n"), F.max("_twin").alias("_twin"),
        F.min(F.struct("district", "taluk", F.col("b.village").alias("village"), F.col("b.parts").alias("parts"))).alias("a"), F.flatten(F.collect_list("_labels")).alias("_labels"),
    )
    settled = settled.where((F.col("_n") == 1) & ~(F.col("hint").isin("neighbour-taluk", "census-2011") & F.col("_twin")))
    label = F.when(F.col("hint") == "taluk", F.coalesce(*[F.when(F.array_contains("_labels", x), x) for x in TALUK_HINTS])).otherwise(F.col("hint"))
    answers = [stored(settled.select(key, "hint", label.alias("source"), F.col("a.district").alias("district"), F.col("a.taluk").alias("taluk"), F.col("a.village").alias("village"), F.col("a.parts").alias("parts")), "settled")]

    if not again:
        answers += _by_name(open_, key, register, v, lone, ct, hints)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("hint"))
    best = reduce(DataFrame.unionByName, answers).groupBy(key).agg(F.min_by(F.struct("source", "district", "taluk", "village", "parts"), rank).alias("_a"))
    out = rows.join(best, key, "left")
    placed = F.col("_a").isNotNull()
    new = {
        "district_source": F.when(placed & F.col("district").isNull(), F.col("_a.source")).otherwise(F.col("district_source")),
        "district": F.when(placed, F.col("_a.district")).otherwise(F.col("district")),
        "taluk": F.when(placed, F.col("_a.taluk")).otherwise(F.col("taluk")),
        "village": F.coalesce("village", "_a.village"),
        "parts": F.coalesce("parts", "_a.parts"),
        "village_source": F.when(placed, F.col("_a.source")).otherwise(F.col("village_source")),
        "town": F.when(~placed, F.col("town")),
        "town_kind": F.when(~placed, F.col("town_kind")),
        "village_status": F.when(placed, F.when(F.col("_a.village").isNotNull(), "resolved").otherwise("one-of-parts")).otherwise(F.col("village_status")),
    }
    out = out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], (~placed | (F.col("_a.source") == "lgd-town")).alias("_townless"))
    if towns is None:
        return out.drop("_townless")
    # a town is a label of what no hint before it placed, and its only taluk is the row's
    out = out.drop("town", "town_kind").join(towns, key, "left")
    gives = F.col("_townless") & F.col("taluk").isNull() & F.col("only_taluk").isNotNull()
    out = out.withColumns({
        "district_source": F.when(gives & F.col("district").isNull(), "lgd-town").otherwise(F.col("district_source")), "district": F.when(gives, F.col("town_district")).otherwise(F.col("district")),
        "taluk": F.when(gives, F.col("only_taluk")).otherwise(F.col("taluk")), "town": F.when(F.col("_townless"), F.col("town")), "town_kind": F.when(F.col("_townless"), F.col("town_kind")),
    })
    return out.select(*rows.columns)


def hinted_places(resolved: DataFrame, notices: DataFrame, register: DataFrame, key: str, hints: Hints, rounds: int = 2) -> DataFrame:
    """The rows of ``resolved_places`` with open ones placed by hints, and town, town_kind.

    ``notices`` has key (unique), village, taluk, registration, city, pin,
    panchayat and text, any of them null but the key; other columns are not read.
    Only rows of status ``no-parent-taluk`` or ``unmatched`` are placed, the
    source says by which hint. ``rounds`` more than one learn offices, PIN codes
    and neighbours from what is placed by then. Empty tables give empty or
    unchanged rows; texts of any length are read whole.
    """
    said = notices.select(key, F.col("village").alias("said_village"), F.col("taluk").alias("said_taluk"), "registration", "city", "pin", "panchayat", "text")
    none = F.lit(None).cast("string")
    name = F.col("village")
    register = stored(register.select("district", "taluk", "village", "spoken", P.place_key(name).alias("key"), P.sound_key(name).alias("sound"), P.village_shape(name).alias("shape")), "register")
    # keys of names are made once for each name, not for each row and hint
    said_ = F.col("_said")
    keys = {"said_village": {"_village_key": P.place_key(said_), "_village_sound": P.sound_key(said_), "_village_shape": P.village_shape(said_), "_pieces": village_pieces(said_)}}
    keys |= {"said_taluk": {"_taluk_key": P.place_key(said_)}, "registration": {"_office": office_key(said_)}, "panchayat": {"_panchayat_key": P.place_key(said_)}}
    rows = resolved.join(with_keys(said, keys), key)
    rows = stored(rows.withColumns({"town": none, "town_kind": none}), "hinted")
    for at in range(rounds):
        now = hints
        if at:
            taught = learned(rows, notices, key, register)
            more = taught.neighbours if hints.neighbours is None else hints.neighbours.select("taluk", "other").union(taught.neighbours).distinct()
            now = replace(hints, offices=_with(hints.offices, taught.offices, "office"), pins=_with(hints.pins, taught.pins, "pin"), neighbours=more)
        rows = stored(_one_round(rows, key, register, now, again=at > 0), "hinted")
    return rows.select(*resolved.columns, "town", "town_kind")
