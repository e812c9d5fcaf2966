"""Hints one by one: what each places, what cancels or refuses it, and odd rows."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import place_hints as H
from lotwise.operators import places as O

REGISTER = [
    ("Villupuram", "Villupuram", "Kandamanadi"), ("Villupuram", "Villupuram", "Nallur"), ("Villupuram", "Tindivanam", "Nallur"), ("Villupuram", "Tindivanam", "Omandur"),
    ("Villupuram", "Marakkanam", "Brahmadesam"), ("Villupuram", "Marakkanam", "Padappai (Ct)"), ("Villupuram", "Marakkanam", "Padappai"), ("Villupuram", "Gingee", "Meikudipatti"),
    ("Chennai", "Maduravoyal", "Valasaravakkam"), ("Chennai", "Maduravoyal", "Thiruvanmaiyur"), ("Tiruvallur", "Poonamallee", "Noombal"), ("Tiruvallur", "Poonamallee", "Varadharajapuram"),
    ("Chennai", "Egmore", "Varatharajapuramm"), ("Tiruvallur", "Ponneri", "Kattupalli"), ("Coimbatore", "Sulur", "Arasur"), ("Coimbatore", "Annur", "Karamadai"), ("Coimbatore", "Annur", "Kariampalayam"),
]
FIELDS = ["district", "taluk", "village", "registration", "city", "pin", "panchayat", "text"]


def ask(**given):
    assert set(given) <= set(FIELDS)
    return tuple(given.get(f) for f in FIELDS)


# (notice, (taluk, village, parts, source, status))
CASES = [
    (ask(district="Villupuram", village="Nallur", city="Near lake, Tindivanam Town"), ("Tindivanam", "Nallur", None, "city-taluk", "resolved")),
    (ask(district="Villupuram", village="Nallur", city="Tindivanam", pin="605602"), (None, None, None, None, "no-parent-taluk")),
    (ask(district="Villupuram", village="Omandur", city="Tindivanam", pin="605602"), ("Tindivanam", "Omandur", None, "city-taluk", "resolved")),
    (ask(district="Villupuram", village="Kandamanadi", pin="605602"), ("Villupuram", "Kandamanadi", None, "pin-taluk", "resolved")),
    (ask(district="Villupuram", village="Omandur", registration="Tindivanam Joint-II S.R.O."), ("Tindivanam", "Omandur", None, "sro-taluk", "resolved")),
    (ask(district="Coimbatore", village="Omandur", city="Tindivanam"), (None, None, None, None, "no-parent-taluk")),
    (ask(district="Villupuram", village="Meykudipatti"), ("Gingee", "Meikudipatti", None, "district-sound", "resolved")),
    (ask(district="Villupuram", village="Meykudipatti 2"), (None, None, None, None, "no-parent-taluk")),
    (ask(district="Chennai", village="Thiruvanmiyur"), ("Maduravoyal", "Thiruvanmaiyur", None, "district-fuzzy", "resolved")),
    (ask(taluk="Marakkanam", village="Brahmadesam Town and Gandhi Nagar"), ("Marakkanam", "Brahmadesam", None, "village-pieces", "resolved")),
    (ask(taluk="Marakkanam", village="Brahmadesam, Elsewhere"), ("Marakkanam", None, None, None, "unmatched")),
    (ask(taluk="Gingee", village="Kandamanadii Hamlet, Ward 5"), ("Gingee", None, None, None, "unmatched")),
    (ask(taluk="Tindivanam", village="Nowhere Desam"), ("Tindivanam", None, None, None, "unmatched")),
    (ask(taluk="Tindivanam", village="Brahmadesham"), ("Marakkanam", "Brahmadesam", None, "neighbour-taluk", "resolved")),
    (ask(taluk="Tindivanam", village="Patappay"), ("Tindivanam", None, None, None, "unmatched")),
    (ask(taluk="Maduravoyal", village="Noombal"), ("Poonamallee", "Noombal", None, "metro-unique", "resolved")),
    (ask(taluk="Maduravoyal", village="Kattupalli"), ("Maduravoyal", None, None, None, "unmatched")),
    (ask(taluk="Maduravoyal", village="Varadharajapuram"), ("Maduravoyal", None, None, None, "unmatched")),
    (ask(taluk="Annur", village="Somewhere", panchayat="Kariampalayam Panchayat"), ("Annur", None, "Karamadai,Kariampalayam", "gram-panchayat", "one-of-parts")),
    (ask(taluk="Annur", village="Somewhere", panchayat="Annur Town Panchayat"), ("Annur", None, None, None, "unmatched")),
    (ask(district="Coimbatore", village="Puthur"), ("Annur", None, "Karamadai", "habitation", "one-of-parts")),
    (ask(district="Coimbatore", village="Colony"), (None, None, None, None, "no-parent-taluk")),
    (ask(district="Coimbatore", taluk="Avinashi", village="Old Arasur"), ("Sulur", "Arasur", None, "census-2011", "resolved")),
    (ask(district="Coimbatore", taluk="Kovai", village="Karamadai"), ("Annur", "Karamadai", None, "census-2011", "resolved")),
    (ask(district="Coimbatore", village="Karamadai", text="house at Annur Pudur Town, near lake"), ("Annur", "Karamadai", None, "lgd-town", "resolved")),
    (ask(district="Coimbatore", village="Unheard", text="house at Annur Pudur Town, near lake"), ("Annur", None, None, None, "no-parent-taluk")),
    (ask(district="Coimbatore", village="Unheard", text="by order of the Annur Pudur Town and Country Planning office"), (None, None, None, None, "no-parent-taluk")),
    (ask(district="Coimbatore", text="x " * 20000), (None, None, None, None, "absent")),
    (ask(), (None, None, None, None, "absent")),
]


def hints(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return H.Hints(
        offices=table([("tintifanam", "Tindivanam")], "office string, taluk string").select(H.office_key(F.lit("Tindivanam")).alias("office"), "taluk"),
        pins=table([("605602", "Villupuram")], "pin string, taluk string"),
        neighbours=table([("Tindivanam", "Marakkanam"), ("Tindivanam", "Sulur"), ("Gingee", "Tindivanam")], "taluk string, other string"),
        panchayats=table([("Annur", "Kariampalayam", "Karamadai"), ("Annur", "Kariampalayam", "Kariampalayam"), ("Annur", "Annur Town", "Karamadai")], "taluk string, panchayat string, village string"),
        hamlets=table([(1, "Puthur", "Annur", "Karamadai"), (1, "Colony", "Annur", "Karamadai"), (2, "Colony", "Annur", "Kariampalayam")], "code int, hamlet string, taluk string, village string"),
        lineage=table([("Avinashi", "Old Arasur", "Sulur", "Arasur"), ("Kovai North", None, "Sulur", None), ("Kovai South", None, "Annur", None)], "old string, village string, taluk string, now string"),
        towns=table([("Annur Pudur", "town-panchayat", "Coimbatore", "Annur")], "town string, kind string, district string, taluk string"),
        metro=("Chennai", "Tiruvallur"),
        core=("Maduravoyal", "Egmore", "Poonamallee"),
    )


@pytest.fixture(scope="module")
def tables(spark):
    register = spark.createDataFrame([(*r, None) for r in REGISTER], "district string, taluk string, village string, spoken string")
    notices = spark.createDataFrame([(i, *given, "other") for i, (given, _) in enumerate(CASES)], f"id int, {', '.join(f + ' string' for f in FIELDS)}, source string").withColumn("state", F.lit(None).cast("string"))
    return notices, register, O.resolved_places(notices, register, "id", [], [])


def test_hints(spark, tables):
    notices, register, resolved = tables
    out = H.hinted_places(resolved, notices, register, "id", hints(spark), rounds=1)
    rows = {r["id"]: r for r in out.collect()}
    wrong = [(given, (r["taluk"], r["village"], r["parts"], r["village_source"], r["village_status"]), want) for i, (given, want) in enumerate(CASES) for r in [rows[i]] if (r["taluk"], r["village"], r["parts"], r["village_source"], r["village_status"]) != want]
    assert not wrong
    assert len(rows) == len(CASES)
    towns = {i: r["town"] for i, r in rows.items() if r["town"]}
    assert set(towns.values()) == {"Annur Pudur"} and len(towns) == 2


def test_rounds_learn(spark, tables):
    """Three notices placed by their city teach their office; a fourth, which names only that, is placed in the next round."""
    _, register, _ = tables
    given = [ask(district="Villupuram", village="Nallur", city="Tindivanam", registration="Olakkur SRO")] * 3 + [ask(district="Villupuram", village="Nallur", registration="Sub-Registrar Office, Olakkur")]
    notices = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], f"id int, {', '.join(f + ' string' for f in FIELDS)}").withColumn("state", F.lit(None).cast("string"))
    resolved = O.resolved_places(notices, register, "id", [], [])
    last = lambda n: H.hinted_places(resolved, notices, register, "id", H.Hints(), rounds=n).where("id = 3").first()
    assert last(1)["village"] is None
    assert (last(2)["taluk"], last(2)["village_source"]) == ("Tindivanam", "sro-taluk")


def test_empty(spark, tables):
    notices, register, resolved = tables
    assert H.hinted_places(resolved.where("false"), notices, register, "id", hints(spark), rounds=1).count() == 0
    none = O.resolved_places(notices, register.where("false"), "id", [], [])
    assert H.hinted_places(none, notices, register.where("false"), "id", hints(spark), rounds=1).where("village IS NOT NULL").count() == 0


def test_pieces_and_offices(spark):
    rows = spark.createDataFrame([("Kanthalur and Pulipakkam",), ("Ambur Municipal Town",), ("Ambur",), ("Puthur hamlet of Alladu",), ("X Street, Y Nagar",), ("",), (None,)], "v string")
    got = [r[0] for r in rows.select(H.village_pieces(F.col("v"))).collect()]
    assert got == [["Kanthalur", "Pulipakkam"], ["Ambur"], [], ["Alladu"], [], [], []]
    offices = spark.createDataFrame([("Chengalpet Joint-II SRO",), ("Chengalpet",), ("Sub-Registrar Office, Chengalpattu No 2",), ("SRO",), (None,)], "o string")
    keys = [r[0] for r in offices.select(H.office_key(F.col("o"))).collect()]
    assert keys[0] == keys[1] and keys[2] is not None and keys[3:] == [None, None]
