"""Tables on grids, lots by their marks, and spans of edited excerpts, against cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import grids, lot_layouts, spans
from lotwise.plans import layout_queries

SMALL = "/root/testdata/sf0.001"


# grids ----------------------------------------------------------------------


def slots(spark, text):
    rows = grids.table_grid(spark.createDataFrame([(1, text, "x")], "id int, text string, value string"), "id", "text")
    return sorted([r.asDict() for r in rows.collect()], key=lambda r: (r["table_no"], r["row_no"], r["col"]))


def test_spans_cover_slots(spark):
    text = '<table><tr><th>Sr. No.</th><th colspan=2>Description</th><th>EMD (in Lakhs)</th></tr><tr><td rowspan="2">1</td><td>a</td><td>b</td><td>1.5</td></tr><tr><td>c</td><td>d</td><td>2</td></tr></table>'
    got = slots(spark, text)
    assert [[r["value"] for r in got if r["row_no"] == k] for k in (0, 1)] == [["1", "a", "b", "1.5"], ["1", "c", "d", "2"]]
    assert [r["role"] for r in got if r["row_no"] == 0] == ["serial", "description", "description", "emd"]
    assert [r["amount"] for r in got if r["col"] == 3 and r["row_no"] >= 0] == [150_000, 200_000] and all(r["lot_row"] for r in got)
    assert all(text[r["start"] : r["stop"]].strip() == r["value"] for r in got)


def test_headers(spark):
    money = "<table><tr><td>Name</td><td>Reserve price</td></tr><tr><td>x</td><td>Rs. 5,00,000</td></tr><tr><td>y</td><td>on request</td></tr></table>"
    got = slots(spark, money)
    assert {r["row_no"] for r in got} == {-1, 0, 1} and not any(r["lot_row"] for r in got)  # one row lacks a figure
    none = slots(spark, "<table><tr><td>Rs.5</td><td>01-02-2024</td></tr><tr><td>Rs.6</td><td>02.03.24</td></tr></table>")
    assert {r["row_no"] for r in none} == {0, 1} and [(r["role"], r["role_from"]) for r in none[:2]] == [("amount", "cells"), ("date", "cells")]


def test_broken_and_nested_tables(spark):
    text = "x <table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>lost</table> <table><tr><td>open"
    assert [(r["table_no"], r["row_no"], r["col"], r["value"]) for r in slots(spark, text)] == [(0, 0, 0, "in"), (1, 0, 0, "a in"), (1, 0, 1, "b")]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no table"), (4, "<table></table>"), (5, '<table><tr><td colspan="9999999" rowspan="0">w</td></tr></table>')], "id int, text string")
    got = grids.table_grid(odd, "id", "text")
    assert got.groupBy("id").count().collect() == [(5, 1000)]
    assert grids.table_grid(odd.where("id < 0"), "id", "text").count() == 0


@pytest.mark.parametrize(
    ("header", "role"),
    [("S.No", "serial"), ("Lot No.", "serial"), ("Earnest Money Deposit", "emd"), ("E.M.D", "emd"), ("Upset Price", "reserve_price"), ("Bid increment amount", "bid_increment"), ("Total dues", "outstanding"), ("Name of the Guarantor", "borrower"), ("Type of Possession", "possession"), ("Date & time", "date"), ("Measurement", "extent"), ("Schedule of property", "description"), ("Remarks", None), ("Update", None)],
)
def test_roles(spark, header, role):
    assert spark.createDataFrame([(header,)], "h string").select(grids.role_of(F.col("h"))).first()[0] == role


def test_units(spark):
    heads = ["Reserve Price (In Lakhs)", "EMD (Rs. in Crores)", "Price (Rs. lac)", "Price in lakhs", "Price (Rs)"]
    assert [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h string").select(grids.unit_of(F.col("h"))).collect()] == ["lakh", "crore", "lakh", None, None]


# lots -----------------------------------------------------------------------


def test_longest_chain_equals_all_subsequences():
    random.seed(6)
    for _ in range(200):
        marks = [(i, random.randrange(1, 7)) for i in range(random.randrange(1, 11))]
        runs = []
        for pick in range(1, 1 << len(marks)):
            some = [m for i, m in enumerate(marks) if pick >> i & 1]
            if all(b[1] == a[1] + 1 for a, b in zip(some[:-1], some[1:], strict=True)):
                runs.append(len(some))
        chain = lot_layouts.longest_chain(random.sample(marks, len(marks)))
        assert len(chain) == max(runs) and chain == sorted(chain) and all(b[1] == a[1] + 1 for a, b in zip(chain[:-1], chain[1:], strict=True))


def lots_of(text, n):
    found = lot_layouts.lots_of(text, n)
    return found and (found[0], [(text[a:b], k) for a, b, k in found[1]])


def test_price_lines_close_lots():
    text = "a\nReserve price: Rs.5/-\nb\nreserve PRICE is ₹ 6 lakh\nterms: not below the reserve price"
    assert lots_of(text, 2) == ("price", [("a\nReserve price: Rs.5/-\n", None), ("b\nreserve PRICE is ₹ 6 lakh\n", None)])
    assert lots_of(text, 3) is None and lots_of(None, 1) is None and lots_of("x", None) is None
    row = "<table><tr><td>x Reserve price Rs 5</td></tr><tr><td>y Reserve price Rs 6</td></tr></table>"
    assert [t for t, _ in lots_of(row, 2)[1]] == ["<table><tr><td>x Reserve price Rs 5</td></tr>", "<tr><td>y Reserve price Rs 6</td></tr>"]


def test_numbers_open_lots():
    serial = '<tr><td align="center"><b>1.</b></td><td>Rs 5</td></tr><tr><td>EMD</td></tr><tr><td rowspan="3">2</td><td>Rs 6</td></tr><tr><td>2024</td></tr>'
    assert [(t[:8], k) for t, k in lots_of(serial, 2)[1]] == [("<tr><td ", 1), ("<tr><td ", 2)]
    text = "Clauses\n7. No money here\n1. Flat Rs 5\n## Lot No: 2 House Rs.6\n3) Land Rs 7\n"
    assert lots_of(text, 3) == ("numbered", [("1. Flat Rs 5\n", 1), ("## Lot No: 2 House Rs.6\n", 2), ("3) Land Rs 7\n", 3)])
    assert lots_of(text.replace("Rs.6", "six"), 3) is None  # a lot without money
    mixed = "3. Land Rs 7\n4. Shop Rs 8\n1. Flat Rs 5\n2. House Rs 6\n"
    assert [k for _, k in lots_of(mixed, 4)[1]] == [3, 4, 1, 2]
    assert lots_of(mixed + "5. Mill Rs 9\n", 4) is None  # the numbers go on


def test_numbers_win_where_prices_spill():
    lot = "Lot No. {} x\nReserve price: Rs.5\n{}\n"
    assert lots_of("".join(lot.format(k, "possession " * 12) for k in (1, 2, 3)), 3)[0] == "numbered"
    assert lots_of("".join(lot.format(k, "short") for k in (1, 2, 3)), 3)[0] == "price"


def test_chunks():
    assert lot_layouts.chunk_numbers([(i, i + 1, None) for i in range(12)]) == [0] * 5 + [1] * 5 + [2] * 2
    assert lot_layouts.chunk_numbers([(i * 9000, i * 9000 + 9000, None) for i in range(3)]) == [0, 1, 2]


def test_lots_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "x", None), (4, "1. A Rs 5\n2. B Rs 6\n" + "z" * 100_000, 2), (5, "1. A Rs 5", -1)], "id int, text string, n int")
    got = lot_layouts.find_lots(rows, "id", "text", "n").collect()
    assert [(r["id"], r["start"], r["stop"], r["chunk"]) for r in got] == [(4, 0, 10, None), (4, 10, 3010, None)]


# spans ----------------------------------------------------------------------


def by_table(excerpt, text):
    """Likeness, start and stop by the full table of edits, with all starts of each end."""
    excerpt, text = spans.lower(excerpt.strip()), spans.lower(text)
    column = [(i, 0) for i in range(len(excerpt) + 1)]  # edits, then the negative of the start
    best = (len(excerpt), 0, 0)
    for j, c in enumerate(text, 1):
        above = column
        column = [(0, -j)]
        for i, e in enumerate(excerpt, 1):
            column.append(min((above[i - 1][0] + (c != e), above[i - 1][1]), (above[i][0] + 1, above[i][1]), (column[i - 1][0] + 1, column[i - 1][1])))
        if column[-1][0] < best[0]:
            best = (column[-1][0], -column[-1][1], j)
    edits, start, stop = best
    return 100 * (1 - edits / len(excerpt)), start, stop


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcde ")
        elif kind == 1:
            out.insert(at, rng.choice("abcde "))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab ", "abcdefghij klm"])
def test_spans_equal_the_full_table(letters):
    rng = random.Random(9)
    seen = 0
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 160)))
        at = rng.randrange(len(text))
        excerpt = edited(rng, text[at : at + rng.randrange(1, 60)] or "a", rng.randrange(8))
        if not excerpt.strip():
            continue
        want, got = by_table(excerpt, text), spans.best_span(excerpt, text)
        assert got == (want if want[0] >= spans.LEAST else None)
        seen += got is not None
    assert seen > 150


def test_spans_keep_places_where_case_changes_length():
    assert spans.best_span("straße İ x", "zz STRAßE İ X yy")[1:] == (3, 13)
    assert spans.best_span(None, "x") is None and spans.best_span("x", None) is None and spans.best_span(" ", "x") is None
    assert spans.best_span("needle in hay", "hay " * 50_000 + "needle in hay")[1:] == (200_000, 200_013)


def test_marks_keep_to_words_and_out_of_tags(spark):
    text = "<td>Tamilnadu, 625602</td><td>All the Piece of land 12.1.2025)</td> tail a < b"
    cases = [("ll the Piec", "All the Piece"), ("l the piece of land 12.1.202", "All the Piece of land 12.1.2025)"), ("nadu, 62560", "Tamilnadu, 625602"), ("<td>all the piece", "All the Piece"), ("2025)</td", "12.1.2025)")]
    rows = spark.createDataFrame([(e, text) for e, _ in cases], "e string, t string")
    got = [text[r["mark_start"] : r["mark_stop"]] for r in spans.located(rows, "e", "t").collect()]
    assert got == [w for _, w in cases]


def test_passages_equal_whole_alignments(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()}
    got = [r.asDict() for r in layout_queries.located_passages(spark, SMALL).collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert got
    docs |= {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id").isin([r["doc_id"] for r in got])).collect()}
    for r in got:
        assert (r["likeness"], r["start"], r["stop"]) == pytest.approx(by_table(items[r["item_id"]], docs[r["doc_id"]]))
    seen = {(r["item_id"], r["doc_id"]) for r in got}
    for d, text in docs.items():
        for i, passage in items.items():
            assert ((i, d) in seen) or passage.lower() not in (text or "").lower()
