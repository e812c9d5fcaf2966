"""Whole licence texts, with titles, holders and any line breaks."""

import textwrap
from pathlib import Path

import pytest

from lotwise.llm import licenses

COMMON = Path("/usr/share/common-licenses")
BSD_2 = """Copyright 2021, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def wrapped(text: str, width: int) -> str:
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def scanned(spark, texts: list[str]) -> list[tuple]:
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_titled_texts(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    isc = next(t for i, t in licenses.KNOWN if i == "ISC")
    texts = [f"{title}\n\nCopyright (c) 2020 Somebody\nCopyright (c) 2021 Somebody Else\n\n{mit}" for title in ("MIT License", "The MIT License (MIT)")]
    texts += [f"ISC License\n\nCopyright (c) 2020 Somebody\n\n{isc}", BSD_2, "BSD 2-Clause License\n\n" + wrapped(BSD_2, 72)]
    assert [r[0] for r in scanned(spark, texts)] == ["MIT", "MIT", "ISC", "BSD-2-Clause", "BSD-2-Clause"]
    assert [r[0] for r in scanned(spark, [t + "\nand more" for t in texts])] == [None] * 5
    assert scanned(spark, ["see\n" + " ".join(BSD_2.split("\n\n")[1:]).replace("\n", " ")]) == [(None, 1, "BSD-2-Clause")]


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_whole_texts_at_any_width(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    whole = [(COMMON / n).read_text() for n in names]
    assert [r[0] for r in scanned(spark, whole)] == list(names.values())
    for width in (50, 66, 100, 10_000):
        assert [r[0] for r in scanned(spark, [wrapped(t, width) for t in whole[:1]])] == ["Apache-2.0"]


def test_holders_end_where_the_licence_opens(spark):
    """On one line, with a title, and with a holder over two lines; what isn't a holder keeps the text unknown."""
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    isc = next(t for i, t in licenses.KNOWN if i == "ISC")
    found = [
        f"Copyright (c) 2020 Foo. {mit}",
        f"MIT License Copyright (c) 2020 Foo {mit}",
        f"The MIT License (MIT)\n\nCopyright (c) 2019-2021 Foo, Inc. and\nthe Bar contributors\n\n{mit}",
        f"MIT License\n\nCopyright 2020 Foo and\n    the Bar contributors. All rights\nreserved.\n{wrapped(mit, 60)}",
        f"ISC Licence\nCOPYRIGHT Foo {isc}",
        BSD_2.replace("\n", " "),
    ]
    assert [r[0] for r in scanned(spark, found)] == ["MIT"] * 4 + ["ISC", "BSD-2-Clause"]
    unknown = [f"My story. Copyright (c) 2020 Foo. {mit}", f"Copyright (c) 2020 {'Foo and ' * 80} {mit}", f"Copyright (c) 2020 Foo. {mit} And more.", "Copyright (c) 2020 Foo"]
    assert [r[0] for r in scanned(spark, unknown)] == [None] * 4
    assert scanned(spark, [f"before\nCopyright (c) 2020 Foo. {mit}\nafter".replace("\n\n", " ")])[0][1:] == (1, "MIT")


def test_sql_finds_the_same_forms(spark):
    import duckdb

    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    texts = [f"MIT License Copyright (c) 2020 Foo {mit}", f"(c) 2020 X\n{mit}", "© Foo\nReleased under the MIT Licence", "copyright law is\n[c] all rights reserved.", "", None, " - ", f"The MIT License\nCopyright (C) 2020 Foo and\nBar\n\n{mit}", BSD_2]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.sql(licenses.ORACLE).fetchall())
