"""License scans by canonical digests (operator 5).

A text is brought to a canonical form: lower case, runs of punctuation and white
space as one space, equivalent spellings as one, and without what names a
copyright's holder or year. Where a statement of copyright leads to a licence's
opening words, all between the two is taken for the holder, wherever lines break
(up to HOLDER_CHARS characters, and with a title before it); elsewhere lines
that name a holder or a year go. The digest
of the entire form is looked up among those of known licence texts and notices by
a hash join. Documents are looked up as a whole, and each of their lines as a
text of its own. license_texts.csv has the digests of whole texts with their
usual titles and variants.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 license."),
    ("Unlicense", "Released under the Unlicense."),
]

# Spellings that count as the same, after punctuation became spaces.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_APART = r"[^\p{L}\p{N}]+"
#: Lines that name a copyright's holder or year, or reserve rights; not any line that begins with the word.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(copyright[^\n]*(©|\(c\)|\p{N}{4}|<|\[)|©|\(c\)[ \t]*(copyright|\p{N}{4}|<)|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"


# The words that licences with a holder open with, and titles before the holder, in canonical form.
OPENINGS = ["permission is hereby granted free of charge", "permission to use copy modify", "redistribution and use in source and binary forms"]
TITLES = [
    "mit license", "the mit license", "the mit license mit", "mit", "isc license", "isc license isc", "the isc license", "isc", "bsd zero clause license", "zero clause bsd", "0bsd",
    "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "bsd license", "the bsd license",
]
#: Characters of holders and years between "copyright" and a licence's opening, at most.
HOLDER_CHARS = 400
_HEAD = rf"^(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))}) )?copyright .{{0,{HOLDER_CHARS}}}?(?=(?:{'|'.join(OPENINGS)})\b)"
_OPENS = r"(?:permission\s+(?:is\s+hereby|to\s+use)|redistribution\s+and\s+use)"


def canonical(text: Column) -> Column:
    """The canonical form; null for a null text and for one without letters and digits."""
    lower = F.lower(text)
    headed = F.when(lower.contains("copyright") & lower.rlike(_OPENS), _plain(lower))
    body = F.when(headed.rlike(_HEAD), F.regexp_replace(headed, _HEAD, ""))
    return F.coalesce(body, _plain(F.regexp_replace(lower, _COPYRIGHT, "")))


def _plain(lower: Column) -> Column:
    def spelt(form: Column) -> Column:
        for other, usual in EQUIVALENT:
            form = F.replace(form, F.lit(f" {other} "), F.lit(f" {usual} "))
        return F.trim(form)

    # a variable of a lambda is computed once, however often the next step names it
    words = F.transform(F.array(F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _APART, " ")), F.lit(" "))), spelt)
    return F.element_at(F.transform(words, lambda form: F.when(form != "", form)), 1)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def license_texts() -> list[tuple[str, str]]:
    """(digest, licence) of the packaged texts, about two hundred."""
    with Path(__file__).with_name("license_texts.csv").open(newline="") as f:
        return [(r["digest"], r["license_id"]) for r in csv.DictReader(f)]


def known_licenses(spark: SparkSession) -> DataFrame:
    """digest, license_id: a fixed table of about two hundred rows; one licence for each digest, the least by name."""
    notices = spark.createDataFrame(KNOWN, "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
    texts = spark.createDataFrame(license_texts(), "digest string, license_id string")
    return notices.unionByName(texts).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def identified(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with license_id: the licence that the entire ``text`` is, or null."""
    found = rows.withColumn("digest", digest(F.col(text))).join(F.broadcast(known_licenses(rows.sparkSession)), "digest", "left")
    return found.select(*rows.columns, "license_id")


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, license_id, notice_lines, notices.

    license_id: the licence that the entire text is, or null. notice_lines: how
    many lines are a known text; notices: their licences, sorted, joined by
    commas ('' for none). A null or empty text has none. Rows that repeat a
    doc_id share their notices; a null doc_id has no notices. Very long texts
    are taken whole, an empty table gives no rows, and other columns are ignored,
    whatever their names.
    """
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    notices = identified(lines, "line").where("license_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("notice_lines"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = identified(docs.select("doc_id", "text"), "text").select("doc_id", "license_id")
    return whole.join(notices, "doc_id", "left").select("doc_id", "license_id", F.coalesce("notice_lines", F.lit(0)).alias("notice_lines"), F.coalesce("notices", F.lit("")).alias("notices"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words_sql(text: str) -> str:
    """Words of a lower-case text, each after a space, and a space: by lists, not by the code's replacements."""
    out = f"' ' || array_to_string(list_filter(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' '"
    for other, usual in EQUIVALENT:
        out = f"replace({out}, ' {other} ', ' {usual} ')"
    return f"trim({out})"


# Lines that name a holder or a year, by their begin and what they hold.
_NAMES_HOLDER = r"""(starts_with(regexp_replace(l, '^[^\p{L}\p{N}©]+', ''), 'copyright') AND (contains(l, '©') OR contains(l, '(c)') OR regexp_matches(l, 'copyright.*(\p{N}{4}|<|\[)')))
  OR starts_with(regexp_replace(l, '^[^\p{L}\p{N}©]+', ''), '©') OR regexp_matches(l, '^[^\p{L}\p{N}©]*\(c\)[ \t]*(copyright|\p{N}{4}|<)') OR regexp_matches(l, '^[^\p{L}\p{N}©]*all rights reserved[^\p{L}\p{N}]*$')"""
_PLACES = ", ".join(f"nullif(instr(w, '{o} '), 0)" for o in OPENINGS)
_TITLED = ", ".join(f"'{t}'" for t in TITLES)


def _forms_sql(name: str, rows: str) -> str:
    """A CTE with id, extra and the canonical form of the text t of ``rows`` (id, extra, t)."""
    return f"""{name}_w AS (SELECT id, extra, t, {_words_sql('lower(t)')} AS w FROM ({rows})
), {name}_p AS (SELECT *, least({_PLACES}) AS opens FROM {name}_w
), {name}_h AS (SELECT *, CASE WHEN opens > 0 THEN substr(w, 1, opens - 1) END AS head FROM {name}_p
), {name}_c AS (SELECT *, CASE WHEN head IS NOT NULL THEN instr(' ' || head, ' copyright ') END AS c FROM {name}_h
), {name} AS (SELECT id, extra, sha256(nullif(CASE WHEN c > 0 AND (c = 1 OR substr(head, 1, c - 2) IN ({_TITLED})) AND length(head) - c - 9 <= {HOLDER_CHARS} THEN substr(w, opens)
  ELSE {_words_sql("array_to_string(list_filter(string_split(lower(t), chr(10)), lambda l: NOT (" + _NAMES_HOLDER + ")), chr(10))")} END, '')) AS form FROM {name}_c
)"""


_DIGESTS = ", ".join(f"('{d}', '{i}')" for d, i in license_texts())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH {_forms_sql("notices", "SELECT i AS id, 0 AS extra, t FROM (VALUES " + ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN) + ") AS v(i, t)")}, k AS (
  SELECT form, min(license_id) AS license_id FROM (SELECT form, id AS license_id FROM notices UNION ALL SELECT form, i FROM (VALUES {_DIGESTS}) AS w(form, i)) GROUP BY 1
), {_forms_sql("whole", "SELECT doc_id AS id, 0 AS extra, text AS t FROM documents")}, {_forms_sql("lines", "SELECT doc_id AS id, 0 AS extra, unnest(string_split(text, chr(10))) AS t FROM documents")}, n AS (
  SELECT id, count(*) AS notice_lines, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM lines JOIN k USING (form) GROUP BY id
)
SELECT whole.id AS doc_id, k.license_id, coalesce(notice_lines, 0) AS notice_lines, coalesce(notices, '') AS notices
FROM whole LEFT JOIN k ON k.form = whole.form LEFT JOIN n ON n.id = whole.id
"""
