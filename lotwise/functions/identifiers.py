"""Identifiers that a description gives its own property, not its neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import family_value

_SIDE = r"(?:north|south|east|west)"
#: What a side borders on, up to the clause's end or the next side.
CLAUSE = rf"(?is)(\b{_SIDE}(?:ern)?(?:\s+side)?\s*(?:by|:|-)\s*)(.{{2,120}}?)(?=[;,.\n]|\b{_SIDE}(?:ern)?\b|$)"
# How each family of numbers is announced. A survey or door number may be said to be old or new.
ANNOUNCED = {
    "survey": r"(?:(?:old|new)\s+|t\.?\s*s\.?\s*|r\.?\s*s\.?\s*|re-?survey\s*|survey\s+|s\.?\s*)no\.?s?",
    "door": r"(?:(?:old|new)\s+)?(?:door|d\.?)\s*no\.?s?",
    "plot": r"plot\s+no\.?s?",
    "flat": r"flat(?:\s+no\.?s?)?",
    "villa": r"villa(?:\s+no\.?s?)?",
}
# A number with its subdivisions; neither a word's begin nor an area.
NUMBER = r"(?:\d+[A-Za-z]?|[A-Za-z]{1,2}\d+)(?:\s*(?:/|by|-)\s*\d*[A-Za-z]?\d*)*"
_NOT_AREA = r"(?![a-z])(?![\d.]*\s*(?:sq|sft|cents?\b|acres?\b))"


def outside_clauses(text: Column) -> Column:
    """The text with what its boundary clauses name blanked out, so that places of the rest stay."""
    return F.regexp_replace(text, CLAUSE, "$1 ; ")


def identifiers(text: Column) -> Column:
    """Sorted distinct ``family:value`` of the numbers that a text announces outside boundary clauses; a lone digit is no evidence. Empty for a null text."""
    own = outside_clauses(F.coalesce(text, F.lit("")))
    found = []
    for family, said in ANNOUNCED.items():
        values = F.transform(F.regexp_extract_all(own, F.lit(rf"(?i)\b{said}\s*[:.\-]?\s*({NUMBER}){_NOT_AREA}"), F.lit(1)), family_value)
        telling = F.filter(values, lambda v: F.length(F.replace(v, F.lit("/"), F.lit(""))) >= 2)
        found.append(_named(telling, family))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def _named(values: Column, family: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{family}:"), v))
