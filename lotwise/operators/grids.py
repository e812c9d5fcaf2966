"""Tables of a text on a grid: cells with their places, a header apart, and a role for each column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns that one cell covers at most, as HTML has it.
_WIDEST = 1000

# Words of a header by role, first match wins; those of ``serial`` begin the header.
ROLES = {
    "serial": ["s no", "sno", "sr no", "srno", "sl no", "slno", "lot no", "item"],
    "emd": ["emd", "earnest money"],
    "reserve_price": ["reserve", "upset"],
    "bid_increment": ["increment"],
    "outstanding": ["outstanding", "dues", "amount due", "demand"],
    "borrower": ["borrower", "guarantor", "mortgagor", "name of the"],
    "possession": ["possession"],
    "date": ["date", "time", "auction on"],
    "extent": ["extent", "area", "measur"],
    "description": ["descri", "property", "schedule", "asset"],
}
# Words that stand alone in a header, where the others may be parts of words.
WHOLE = {"emd", "dues", "amount due", "name of the", "date", "time", "auction on", "area", "item"}
# Units that a header declares for its column.
UNITS = {"crore": 10_000_000, "lakh": 100_000}
_UNIT_WORDS = {"crore": "crore", "crores": "crore", "cr": "crore", "lakh": "lakh", "lakhs": "lakh", "lac": "lakh", "lacs": "lakh"}
# What is a figure of money: a currency before a digit, or a number of five signs.
CURRENCIES = ["rs", "₹", "inr"]
MONEY = rf"(?i)(?:{'|'.join(CURRENCIES)})[\s.]*\d|\d[\d,]{{4}}"
_DATE = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"

_TAG = re.compile(r"<(/?)(table|tr|td|th)\b([^>]*)>", re.IGNORECASE)
_SPAN = re.compile(r"\b(colspan|rowspan)\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)


def laid_out(text: str) -> Iterator[tuple]:
    """(table, row, column, rows, columns, start, stop, header) of every cell of the closed rows of a text's closed tables.

    Tables are numbered as they close; a table within a cell is one of its own.
    A cell takes the first columns that no cell above covers.
    """
    opened: list[dict] = []
    closed = 0
    for tag in _TAG.finditer(text):
        name, ends = tag[2].lower(), bool(tag[1])
        if name == "table" and not ends:
            opened.append({"rows": [], "row": None, "cell": None})
        elif opened:
            at = opened[-1]
            if name == "table":
                yield from ((closed, *cell) for cell in _placed(opened.pop()["rows"]))
                closed += 1
            elif name == "tr":
                if ends and at["row"] is not None:
                    at["rows"].append(at["row"])
                at["row"], at["cell"] = (None if ends else []), None
            elif not ends and at["row"] is not None:
                spans = {k.lower(): int(v) for k, v in _SPAN.findall(tag[3])}
                at["cell"] = (tag.end(), name == "th", min(_WIDEST, max(1, spans.get("colspan", 1))), spans.get("rowspan", 1))
            elif ends and at["cell"] is not None:
                start, header, columns, rows = at["cell"]
                at["row"].append((start, tag.start(), header, columns, rows))
                at["cell"] = None


def _placed(rows: list[list[tuple]]) -> Iterator[tuple]:
    covered: dict[int, int] = {}  # column -> first row below what covers it
    for r, cells in enumerate(rows):
        column = 0
        for start, stop, header, columns, down in cells:
            while covered.get(column, 0) > r:
                column += 1
            down = len(rows) - r if down == 0 else min(down, len(rows) - r)
            yield r, column, down, columns, start, stop, header
            for c in range(column, column + columns):
                covered[c] = max(covered.get(c, 0), r + down)
            column += columns


def plain(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", " "), r"\s+", " "))


def role_of(header: Column) -> Column:
    """The role that a header's words name; null if none does."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(header), "['.]", ""), "[^a-z0-9]+", " ")), F.lit(" "))
    out = F.lit(None).cast("string")
    for role, known in reversed(ROLES.items()):
        hit = F.lit(False)
        for w in known:
            hit = hit | (words.startswith(f" {w} ") if role == "serial" else words.contains(f" {w} " if w in WHOLE else f" {w}" if " " in w else w))
        out = F.when(hit, role).otherwise(out)
    return out


def unit_of(header: Column) -> Column:
    """The unit in brackets of a header: lakh, crore or null."""
    word = F.regexp_extract(F.lower(header), rf"\(\s*(?:rs\.?\s*)?(?:in\s+)?({'|'.join(sorted(_UNIT_WORDS, key=len, reverse=True))})\b", 1)
    return F.create_map(*[F.lit(x) for pair in _UNIT_WORDS.items() for x in pair])[word]


def grid_cells(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, row_no, col, rows, cols, start, stop, header and cell (its content) of every cell, as laid out."""
    kind = dict(rows.dtypes)[key]
    names = [key, "table_no", "row_no", "col", "rows", "cols", "start", "stop", "header", "cell"]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *c, t[c[5] : c[6]]) for k, t in zip(batch[key], batch[text], strict=True) for c in laid_out(t)], columns=names)

    some = rows.select(key, text).where(F.lower(F.col(text)).contains("<table"))
    return some.mapInPandas(cells, f"{key} {kind}, table_no int, row_no int, col int, rows int, cols int, start int, stop int, header boolean, cell string")


def table_grid(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, row_no, col, role, role_from, unit, amount, lot_row, start, stop, value: every slot of every table.

    The first row is the header if all its cells are ``th``, or if it holds no
    money and the next row does; its row_no is -1, data rows count from 0. A cell
    over several rows or columns is the value of each. A column's role is what
    its header names, else what most of its cells are (date or amount);
    role_from says which. amount is a cell's first number in the header's unit,
    where the column is of money. lot_row: the table has a column of reserve
    prices (else of deposits) in which every data row has a figure. start and
    stop are places in the text, from 0.
    """
    table, column = Window.partitionBy(key, "table_no"), Window.partitionBy(key, "table_no", "col")
    cells = grid_cells(rows, key, text).withColumn("value", plain(F.col("cell"))).withColumn("money", F.col("value").rlike(MONEY))
    at = lambda n, c: F.max(F.when(F.col("row_no") == n, c)).over(table)
    no_th, first, second = at(0, ~F.col("header")), at(0, F.col("money")), at(1, F.col("money"))
    split = cells.withColumn("split", (~no_th | (~first & F.coalesce(second, F.lit(False)))).cast("int"))
    slots = split.withColumn("_r", F.explode(F.sequence("row_no", F.col("row_no") + F.col("rows") - 1))).withColumn("_c", F.explode(F.sequence("col", F.col("col") + F.col("cols") - 1)))
    slots = slots.select(key, "table_no", (F.col("_r") - F.col("split")).alias("row_no"), F.col("_c").alias("col"), "start", "stop", "value", "money")
    head, body = F.col("row_no") < 0, F.col("row_no") >= 0
    named = F.max(F.when(head, role_of(F.col("value")))).over(column)
    unit = F.max(F.when(head & role_of(F.col("value")).isNotNull(), unit_of(F.col("value")))).over(column)
    n, dates, sums = (F.sum(F.when(body & c, 1).otherwise(0)).over(column) for c in (F.lit(True), F.col("value").rlike(_DATE), F.col("money")))
    voted = F.when(2 * dates > n, "date").when(2 * sums > n, "amount")
    roles = slots.withColumns({"_named": named, "unit": unit, "_voted": voted}).withColumns({"role": F.coalesce("_named", "_voted"), "role_from": F.when(F.col("_named").isNotNull(), "header").when(F.col("_voted").isNotNull(), "cells")})
    number = F.regexp_replace(F.regexp_extract("value", r"\d[\d,]*(?:\.\d+)?", 0), ",", "")
    of_money = F.col("role").isin("emd", "reserve_price", "bid_increment", "outstanding", "amount")
    figure = F.col("money") | (F.col("unit").isNotNull() & (number != ""))
    factor = F.coalesce(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[F.col("unit")], F.lit(1))
    roles = roles.withColumn("amount", F.when(body & of_money & figure & (number != ""), F.round(number.cast("decimal(20,4)") * factor, 2)))
    first_of = lambda role: F.min(F.when((F.col("role") == role) & (F.col("role_from") == "header"), F.col("col"))).over(table)
    main = F.coalesce(first_of("reserve_price"), first_of("emd"))
    held = F.count_if(body & (F.col("col") == F.col("_main")) & figure).over(table)
    data = F.max("row_no").over(table) + 1
    lots = roles.withColumn("_main", main).withColumn("lot_row", F.col("_main").isNotNull() & (data > 0) & (held == data))
    return lots.select(key, "table_no", "row_no", "col", "role", "role_from", "unit", F.col("amount").cast("double").alias("amount"), "lot_row", "start", "stop", "value")
