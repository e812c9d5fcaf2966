"""Where each lot of a notice is, by the marks that its layout prints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What closes a lot (a price line), what opens one (a table row that begins with its number; a paragraph that does, with or without a word before), and what money looks like.
PRICE = r"(?i)reserve\s*price[^\n]{0,40}?(?:rs\.?|₹|inr)\s*\d"
SERIAL = r"(?i)<tr[^>]*>\s*<td[^>]*>\s*(?:<[^>]+>\s*)*(\d{1,3})\s*\.?\s*(?:<[^>]+>\s*)*</td>"
PREFIXED = r"(?im)^[ \t]*(?:#+[ \t]*)?(?:\*\*|<b>)?[ \t]*(?:(?:sl|si|s|sr|lot|item|property)\.?[ \t]*no\.?|no\.?|lot)[ \t]*[:\-]?[ \t]*(\d{1,3})\b"
BARE = r"(?m)^[ \t]*(?:#+[ \t]*)?(?:\*\*|<b>)?[ \t]*(\d{1,3})[ \t]*[.)][ \t]+(?=[A-Za-z(])"
MONEY = r"(?i)(?:rs\.?|₹|inr)\s*\.?\s*\d"
# The last lot's least length, lots and characters of a chunk, and characters beyond which what follows a price belongs to its lot.
LAST_LOT, CHUNK_LOTS, CHUNK_CHARS, SPILL = 3000, 5, 16000, 80

_PRICE, _SERIAL, _PREFIXED, _BARE, _MONEY = (re.compile(p) for p in (PRICE, SERIAL, PREFIXED, BARE, MONEY))
#: (place, number) of a mark, and (start, stop, number) of a lot.
Mark, Lot = tuple[int, int], tuple[int, int, int | None]


def longest_chain(marks: list[Mark]) -> list[Mark]:
    """The longest run of marks n, n + 1, n + 2, .. in order of place; of equally long ones that whose last number is smallest.

    A table over the marks has for each the length of the best run that ends
    there and the mark before it in that run.
    """
    marks = sorted(marks)
    length, before = [1] * len(marks), [-1] * len(marks)
    best: dict[int, int] = {}  # number -> the mark where the first of its longest runs ends
    for i, (_, n) in enumerate(marks):
        if n - 1 in best:
            before[i] = best[n - 1]
            length[i] = length[before[i]] + 1
        if n not in best or length[i] > length[best[n]]:
            best[n] = i
    at = min(best.values(), key=lambda i: (-length[i], marks[i][1]), default=-1)
    run = []
    while at >= 0:
        run.append(marks[at])
        at = before[at]
    return run[::-1]


def numbered_lots(text: str, marks: list[Mark], n: int) -> list[Lot]:
    """Lots that begin at marks: the longest chain, or 1 to n once each in any order, as pages may be joined out of order.

    The last runs one and a half times as long as the longest other, and at
    least LAST_LOT.
    """
    run = longest_chain(marks)
    if len(run) != n:
        wanted = sorted(m for m in marks if 1 <= m[1] <= n)
        if sorted(k for _, k in wanted) == list(range(1, n + 1)) and all(k != n + 1 for _, k in marks):
            run = wanted
    if not run:
        return []
    starts = [at for at, _ in run]
    longest = max((b - a for a, b in zip(starts[:-1], starts[1:], strict=True)), default=0)
    stops = [*starts[1:], min(len(text), starts[-1] + max(LAST_LOT, longest * 3 // 2))]
    return [(a, b, k) for a, b, (_, k) in zip(starts, stops, run, strict=True)]


def priced_lots(text: str) -> list[Lot]:
    """Lots that each end with the table row, else the line, that holds their price."""
    stops: list[int] = []
    for price in _PRICE.finditer(text):
        line = text.find("\n", price.end()) + 1 or len(text)
        row = text.find("</tr>", price.end(), line)
        stop = line if row < 0 else row + len("</tr>")
        if not stops or stop > stops[-1]:
            stops.append(stop)
    return [(a, b, None) for a, b in zip([0, *stops], stops, strict=False)]


def lots_of(text: str | None, n: int | None) -> tuple[str, list[Lot]] | None:
    """The layout that gives exactly n lots, each with money, and those lots."""
    if not text or not n or n < 0:
        return None
    marks = lambda *patterns: [(m.start(), int(m[1])) for p in patterns for m in p.finditer(text)]
    layouts = {"price": priced_lots(text), "serial": numbered_lots(text, marks(_SERIAL), n), "numbered": numbered_lots(text, marks(_PREFIXED, _BARE), n)}
    fits = {name: lots for name, lots in layouts.items() if len(lots) == n and all(_MONEY.search(text, a, b) for a, b, _ in lots)}
    if not fits:
        return None
    first, by_number = next(iter(fits)), next((k for k in fits if k != "price"), None)
    if first == "price" and by_number and all(len(_PRICE.findall(text, a, b)) == 1 for a, b, _ in fits[by_number]):
        between = [re.sub(r"<[^>]+>|\s", "", text[p[1] : following[0]]) for p, following in zip(fits["price"], fits[by_number][1:], strict=False)]
        if 2 * sum(len(b) > SPILL for b in between) > n - 1:
            first = by_number
    return first, fits[first]


def chunk_numbers(lots: list[Lot]) -> list[int]:
    """Consecutive lots by CHUNK_LOTS, fewer where they go beyond CHUNK_CHARS from the first one's start."""
    out: list[int] = []
    begin = held = 0
    for start, stop, _ in lots:
        if out and held < CHUNK_LOTS and stop - begin <= CHUNK_CHARS:
            out.append(out[-1])
            held += 1
        else:
            out.append(out[-1] + 1 if out else 0)
            begin, held = start, 1
    return out


def find_lots(rows: DataFrame, key: str, text: str, expected: str) -> DataFrame:
    """key, layout, lot_no, start, stop, label, chunk: the lots of each text whose layout gives exactly the expected number.

    Layouts are tried in this order: ``price`` (each lot ends with its reserve
    price), ``serial`` (table rows that begin with a number), ``numbered``
    (paragraphs that do). Numbers have to be one rising chain, or 1 to n once
    each; every lot has to name money. Where a price ends a lot but its numbers
    show that more of it follows, the numbers' layout is taken. Texts that no
    layout fits give no rows, nor do null ones and null numbers. chunk numbers
    the pieces to read at a time; null if one read will do.
    """
    kind = dict(rows.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, n in zip(batch["_key"], batch["_text"], batch["_n"], strict=True):
                layout, lots = lots_of(t, int(n)) or ("", [])
                chunks = chunk_numbers(lots) if len(lots) > CHUNK_LOTS else [None] * len(lots)
                out += [(k, layout, i, *lot, c) for i, (lot, c) in enumerate(zip(lots, chunks, strict=True))]
            found = pd.DataFrame(out, columns=[key, "layout", "lot_no", "start", "stop", "label", "chunk"])
            yield found.astype({"label": "Int32", "chunk": "Int32"})

    asked = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(expected).cast("int").alias("_n")).where("_text IS NOT NULL AND _n > 0")
    return asked.mapInPandas(find, f"`{key}` {kind}, layout string, lot_no int, start int, stop int, label int, chunk int")
