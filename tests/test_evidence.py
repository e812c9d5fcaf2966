"""Identifiers outside boundary clauses, windows of excerpts, Tamil names and parts of names, fidelity: by cases."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import identifiers, normalize, places
from lotwise.operators import spans
from lotwise.operators import text as T


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("S.No. 381 by 5A and S. No 300/3", ["survey:300/3", "survey:381/5a"]),
        ("New Door No: 81A/1, Old Survey No.12", ["door:81a/1", "survey:12"]),
        ("Re-survey No 45-2B; T.S.No. 9/1; R.S. Nos 77", ["survey:45/2b", "survey:77", "survey:9/1"]),
        ("Plot No 28, bounded north by Plot No 27; south by Plot No 29", ["plot:28"]),
        ("Flat No. S2 and Villa 14", ["flat:s2", "villa:14"]),
        ("S.No 3", []),
        ("flat 1200 sq.ft, plot no 40 cents", []),
        ("East by Door No 5/2\nDoor No 7/3", ["door:7/3"]),
        ("", []),
        (None, []),
    ],
)
def test_identifiers(spark, text, found):
    assert one(spark, identifiers.identifiers, text) == found


def test_borrower_keys_drop_forms_of_address(spark):
    assert [one(spark, normalize.borrower_key, t) for t in ("Messrs. Ravi Traders", "M/s Ravi Traders", "Thiru. Ravi, Traders")] == ["ravi traders"] * 3


@pytest.mark.parametrize(("name", "want"), [("Pammal - II", ("Pammal", "II")), ("Konerikuppam (A)", ("Konerikuppam", "A")), ("Kolathur Part 2", ("Kolathur", "2")), ("Vichoor-2", ("Vichoor", "2")), ("Badur R.F.", (None, None)), ("Nelli (013)", (None, None)), ("II", (None, None)), ("Pudur", (None, None)), (None, (None, None))])
def test_parts(spark, name, want):
    whole, part = places.part(F.col("t"))
    assert tuple(spark.createDataFrame([(name,)], "t string").select(whole, part).first()) == want


@pytest.mark.parametrize(
    ("tamil", "latin"),
    [("கருமத்தம்பட்டி", "Karumathampatty"), ("071  செட்டிபுண்ணியம்", "Chettypunniyam"), ("ஆலம்பாடி (நகர்)", "Alambadi"), ("கோவை", "Kovai"), ("கொடை", "Kodai")],
)
def test_tamil_names_meet_their_spellings(spark, tamil, latin):
    read = spark.createDataFrame([(tamil, latin)], "t string, l string").select(places.sound_key(places.tamil_sounds(F.col("t"))), places.sound_key(F.col("l"))).first()
    assert read[0] == read[1] and read[0]


@pytest.mark.parametrize(
    ("name", "shape"),
    [("V. Pudur", (None, "v", "v", "")), ("Kengarai 1", ("1", "1", "", "")), ("Elavur II", ("II", "ii", "", "")), ("Badur R.F.", (None, "", "", "rf")), ("Padappai (Ct)", (None, "", "", "ct")), ("Kolathur (North)", (None, "", "", "north")), ("Nelli (013)", (None, "013", "", ""))],
)
def test_village_shapes(spark, name, shape):
    assert tuple(one(spark, places.village_shape, name)) == shape


def test_windows_merge_and_end_at_the_text(spark):
    text = "x" * 300 + "Lien" + "y" * 100 + "lien" + "z" * 900 + "lien"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "none"), (4, "")], "id int, t string")
    got = [(r["start"], r["stop"], r["hits"]) for r in T.windows(rows, "id", "t", ["lien"]).orderBy("start").collect()]
    assert got == [(60, 648, 2), (1068, len(text), 1)]
    found = {r["id"]: r.asDict() for r in T.dossier_excerpts(rows, "id", "t", "is there a LIEN?", 700).collect()}
    assert found[1]["excerpt"] == "… " + text[60:648] + " …\n… " + text[1068 : 1068 + 700 - 592 - 2] and found[1]["windows"] == 2
    assert [found[i]["excerpt"] for i in (2, 3, 4)] == ["", "none", ""]
    assert {r["excerpt"] for r in T.dossier_excerpts(rows, "id", "t", "what is the", 3).collect()} == {"xxx", "", "non"}


def test_question_terms():
    assert T.question_terms("What does my EC say about mortgages, mortgages or EC?") == ["ec", "mortgages"]


def test_fidelity(spark):
    texts = spark.createDataFrame([(1, "House at Main Road, Salem. Rs. 5,00,000. Owner: K Ravi"), (2, "other"), (3, None)], "id int, t string")
    known = spark.createDataFrame([(1, "house at main road", 500000.0, "k ravi"), (1, "house ad main road", 7.0, ""), (1, None, 5.0, "x"), (2, "nothing of this sort", 1.0, None)], "id int, d string, p double, b string")
    got = {r["id"]: (r["properties"], r["score"]) for r in spans.fidelity(texts, known, "id", "t", "d", "p", "b").collect()}
    assert got == {1: (2, round((100 + 70 * 17 / 18) / 2, 1)), 2: (1, 0.0), 3: (0, None)}
