"""Lengths, neighbours of a plot, headline extents, prices and identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_PER_METRE = 3.28084


def length_feet(text: Column) -> Column:
    """A length in feet: feet and inches, metres, or a bare number of feet; null for an area or no number."""
    low = F.lower(F.trim(text))
    feet = F.nullif(F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*(?:ft|feet|foot|')", 1), F.lit("")).cast("double")
    inches = F.coalesce(F.nullif(F.regexp_extract(low, r"^\d+(?:\.\d+)?\s*(?:ft|feet|foot|')\s*(\d+(?:\.\d+)?)\s*(?:in|\"|'')", 1), F.lit("")).cast("double"), F.lit(0.0))
    metres = F.nullif(F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*(?:m|mtr|mtrs|metre|metres|meter|meters)\.?$", 1), F.lit("")).cast("double")
    bare = F.nullif(F.regexp_extract(low, r"^(\d+(?:\.\d+)?)$", 1), F.lit("")).cast("double")
    return F.when(~low.rlike(r"sq|cent|acre|hect"), F.round(F.coalesce(feet + inches / 12, metres * FEET_PER_METRE, bare), 2))


def adjacency(text: Column) -> Column:
    """What a side of a plot touches, by the first pattern that fits; a setback comes before a road."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = [("setback", r"set\s*back"), ("channel", r"channel|canal|odai|drain"), ("pathway", r"path\s*way|passage|lane"), ("street", r"street"), ("road", r"road|highway|\bnh\b"), ("plot", r"plot|site|land|property|house")]
    out = F.when(low == "", None)
    for kind, pattern in rules:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("other")


def road_width(text: Column) -> Column:
    """Feet of a road, street or pathway that a boundary names; null for other neighbours."""
    width = F.nullif(F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*(?:ft|feet|'|’)", 1), F.lit("")).cast("double")
    return F.when(adjacency(text).isin("road", "street", "pathway"), width)


# Which extent stands for a lot, by its bucket, best first.
HEADLINE = {"flat": ["built_up", "super_built_up", "carpet", "total", "extent", "uds"], "house": ["total", "extent", "built_up"], "": ["total", "extent", "built_up", "carpet"]}


def headline(extents: Column, bucket: Column) -> Column:
    """Of a map of extents by kind the one that stands for the lot; an undivided share of the parent land never does."""
    pick = lambda kinds: F.coalesce(*[F.try_element_at(extents, F.lit(k)) for k in kinds])
    return F.when(bucket == "flat", pick(HEADLINE["flat"])).when(bucket == "house", pick(HEADLINE["house"])).otherwise(pick(HEADLINE[""]))


def amounts_in(text: Column) -> Column:
    """All amounts of a text in whole rupees: plain, grouped either way, or with a lakh or crore unit."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d[\d,]*(?:\.\d+)?\s*(?:crores?|cr|lakhs?|lacs?)?)"), F.lit(1))

    def value(m: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(m, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double")
        return F.round(number * F.when(m.rlike("cr"), 10_000_000.0).when(m.rlike("la"), 100_000.0).otherwise(1.0)).cast("long")

    return F.array_distinct(F.transform(found, value))


def strict_ids(text: Column) -> Column:
    """Parcel numbers with a separator (72/1b); what looks like a date isn't one."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", " ")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(\d+[/-]\d+[a-z]?\d*)\b"), F.lit(1)))


def loose_ids(text: Column) -> Column:
    """Bare numbers of two to five digits, without years."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(\d{2,5})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda v: ~v.rlike("^(19|20)[0-9]{2}$")))


def same_parcel(a: str, b: str, similarity: Column, area_agrees: Column, high: float = 0.6) -> Column:
    """The three-tier gate: strict ids if both have them, else loose ids, else likeness of text and area."""
    sa, sb, la, lb = strict_ids(F.col(a)), strict_ids(F.col(b)), loose_ids(F.col(a)), loose_ids(F.col(b))
    return F.when((F.size(sa) > 0) & (F.size(sb) > 0), F.arrays_overlap(sa, sb)).when((F.size(la) > 0) & (F.size(lb) > 0), F.arrays_overlap(la, lb)).otherwise((similarity >= high) & F.coalesce(area_agrees, F.lit(False)))


def portal_ids(text: Column) -> Column:
    """Listing ids that a text names: six digits, or a portal's prefix and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?:^|[^a-z0-9-])((?:bn|be)-\d+|[1-9]\d{5})(?=$|[^0-9])"), F.lit(1)))
