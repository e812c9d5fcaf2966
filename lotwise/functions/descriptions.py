"""What a property's description holds beside its text: areas, money as a reader sees it, places, and what was glued on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import jaccard, words

# Square feet of the units that descriptions use, without spaces and full stops.
SQUARE_FEET = {
    "squarefeet": 1.0, "squarefoot": 1.0, "sqft": 1.0, "sft": 1.0, "ft2": 1.0,
    "squaremeter": 10.7639, "squaremeters": 10.7639, "squaremetre": 10.7639, "squaremetres": 10.7639, "sqm": 10.7639, "m2": 10.7639,
    "squareyard": 9.0, "squareyards": 9.0, "sqyd": 9.0, "yd2": 9.0,
    "cent": 435.6, "cents": 435.6, "are": 1076.39, "ares": 1076.39, "acre": 43560.0, "acres": 43560.0, "hectare": 107639.0, "hectares": 107639.0, "ground": 2400.0, "grounds": 2400.0,
}
# Words for a place's level at the end of its name, and those for a taluk.
LEVELS = ["taluk", "taluka", "tk", "dist", "district", "village", "vill", "post", "po"]
TALUK_WORDS = ["taluk", "taluka", "tk"]
# Names of form fields that are glued to the end of descriptions.
GLUED_FIELDS = ["Province/State", "City/Town", "Area/Town"]
# Rupees of a unit, and the figure from which it is taken as already in rupees.
MONEY_UNITS = {"lakh": (100_000, 100_000), "crore": (10_000_000, 10_000_000)}
# Figures that recognition has broken: a decimal point before a comma, a letter within digits, two decimal points.
BROKEN = r"\d+\.\d+,\d|\d[OoIl|]\d|\d[OoIl|],|,[OoIl|]\d|\d+\.\d+\.\d"
# Kinds of possession.
POSSESSION = ["symbolic", "physical", "constructive"]


def overlap(a: Column, b: Column) -> Column:
    """Shared words of two characters or more over all of both descriptions, to four places; 0 if either has none."""
    return F.round(jaccard(words(F.coalesce(a, F.lit("")), 2), words(F.coalesce(b, F.lit("")), 2)), 4)


def areas(text: Column) -> Column:
    """All areas that a description names, in square feet to one place, each once and sorted; empty for none.

    A half is rounded up on the exact decimal product, not on its nearest double.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    unit = r"(square\s*(?:feet|foot|met(?:er|re)s?|yards?)|sq\.?\s*(?:ft|m|yd)|s?sft|ft2|m2|yd2|cents?|ares?|acres?|hectares?|grounds?)"
    figures, units = (F.regexp_extract_all(low, F.lit(rf"(\d[\d,]*\.?\d*)\s*{unit}"), F.lit(i)) for i in (1, 2))
    feet = F.create_map(*[x for unit, size in SQUARE_FEET.items() for x in (F.lit(unit), F.lit(str(size)).cast("decimal(10,4)"))])

    def size(n: Column, u: Column) -> Column:
        digits, of = F.replace(n, F.lit(","), F.lit("")), F.try_element_at(feet, F.regexp_replace(u, r"[\s.]", ""))
        # figures beyond 17 digits have no exact product in 38
        return F.coalesce(F.round(digits.try_cast("decimal(27,10)") * of, 1).cast("double"), F.round(digits.try_cast("double") * of.cast("double"), 1))

    sizes = F.zip_with(figures, units, size)
    return F.array_sort(F.array_distinct(F.filter(sizes, lambda s: s.isNotNull() & (s > 0))))


def place_name(name: Column) -> Column:
    """A place's name for comparison: lower case, & as and, no punctuation, no words for its level at the end; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.nullif(F.lower(F.regexp_replace(bare, rf"(?i)(?:\s*\b(?:{'|'.join(LEVELS)})\b)+\s*$", "")), F.lit(""))


def says_taluk(name: Column) -> Column:
    return F.coalesce(name.rlike(rf"(?i)\b(?:{'|'.join(TALUK_WORDS)})\b"), F.lit(False))


def read_money(quote: Column, unit: Column | None = None) -> tuple[Column, Column]:
    """(rupees, state) of a quoted figure: state is ok, none (no figure) or illegible (recognition broke it, or it is zero).

    A full stop in a comma's place of Indian grouping is mended. A unit right
    behind the figure counts, unless an amount in words in brackets comes first;
    else ``unit``, as a column's header gives it. A figure that is already as
    large as its unit is in rupees.
    """
    mended = F.regexp_replace(quote, r"(?<![\d.])(\d{1,2})\.(\d{2}),(\d{3})(?![\d.])", "$1,$2,$3")
    figure = F.regexp_extract(mended, r"\d[\d,]*(?:\.\d+)?", 0)
    value = F.replace(figure, F.lit(","), F.lit("")).try_cast("double")
    tail = F.substring(F.regexp_extract(mended, r"(?s)\d[\d,]*(?:\.\d+)?(.*)$", 1), 1, 14)
    near = F.lower(F.regexp_extract(tail, r"(?i)\b(lakhs?|lacs?|crores?|cr)\b", 1))
    said = F.when((near != "") & ~tail.rlike(r"^\s*/?-?\s*\("), F.when(near.startswith("cr"), "crore").otherwise("lakh"))
    of = F.coalesce(said, unit) if unit is not None else said
    factor = F.lit(1)
    for name, (times, least) in MONEY_UNITS.items():
        factor = F.when((of == name) & (value < least), times).otherwise(factor)
    rupees = F.round(value * factor).cast("long")
    state = F.when(F.trim(F.coalesce(quote, F.lit(""))) == "", "none").when(mended.rlike(BROKEN), "illegible").when(figure == "", "none").when(value.isNull() | (value * factor <= 0), "illegible").otherwise("ok")
    return F.when(state == "ok", rupees), state


def possession(quote: Column) -> Column:
    """The kind of possession that a quote commits to; null for none, and for several."""
    low = F.lower(quote)
    said = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{k}\b"), k) for k in POSSESSION]))
    return F.when(F.size(said) == 1, F.get(said, F.lit(0)))


def without_glued_fields(text: Column) -> Column:
    """A description up to the first form field that is glued to it."""
    fields = "|".join(GLUED_FIELDS)
    return F.when(text.rlike(fields), F.regexp_replace(text, rf"(?s)[ ,;:\-\n\t]*(?:{fields}).*$", "")).otherwise(text)
