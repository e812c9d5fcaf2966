"""The place ladder step by step, its keys, and near names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.functions import places as P
from lotwise.functions.similarity import indel_ratio
from lotwise.operators import places as O

REGISTER = [
    ("Kancheepuram", "Kundrathur", "Kollacheri", None), ("Kancheepuram", "Kundrathur", "Pammal - I", None), ("Kancheepuram", "Kundrathur", "Pammal - II", None), ("Kancheepuram", "Kundrathur", "Mookkanur", None),
    ("Kancheepuram", "Sriperumbudur", "Vallam", None), ("Kancheepuram", "Sriperumbudur", "Nemili", None), ("Kancheepuram", "Sriperumbudur", "Nemili", None), ("Chennai", "Perambur", "Sembium", None), ("Chennai", "Purasawalkam", "Ayanavaram", None),
    ("Coimbatore", "Sulur", "Karumathampatty", "karumattampatti"), ("Coimbatore", "Sulur", "Arasur", "arasur"), ("Coimbatore", "Annur", "Otterpalayam", None), ("Madurai", "Annur East", "Varadarajapuram", None), ("Chennai", "Perambur", "Varadharajapurams", None),
    ("Kancheepuram", "Walajabad", None, None),
]


def ask(state=None, district=None, taluk=None, village=None, registration=None):
    return state, district, taluk, village, registration


CASES = [
    (ask(state="Kerala", district="Chennai", taluk="Sulur", village="Arasur"), (None, None, None, None, "outside-state", False)),
    (ask(district="Palakkad"), (None, None, None, None, "outside-state", False)),
    (ask(taluk="Kundratur Taluk", village="Kolacheri"), ("Kancheepuram", "Kundrathur", "Kollacheri", "taluk", "resolved", False)),
    (ask(district="Chennai", taluk="Kundrathur", village="Mokkanur"), ("Kancheepuram", "Kundrathur", "Mookkanur", "taluk", "resolved", True)),
    (ask(taluk="Kundrathur", village="Pammal"), ("Kancheepuram", "Kundrathur", None, "split-village", "one-of-parts", False)),
    (ask(taluk="Kundrathur", village="Pammal II"), ("Kancheepuram", "Kundrathur", "Pammal - II", "taluk", "resolved", False)),
    (ask(taluk="Kundrathur", village="Kundrathur village"), ("Kancheepuram", "Kundrathur", None, None, "names-a-taluk", False)),
    (ask(taluk="Kundrathur", village="Vallam"), ("Kancheepuram", "Sriperumbudur", "Vallam", "district", "resolved", False)),
    (ask(taluk="Sriperumbudur", village="Nemili"), ("Kancheepuram", "Sriperumbudur", None, None, "unmatched", False)),
    (ask(taluk="Sriperumbudur Taluk, Now Kundrathur Taluk", village="Kollacheri"), ("Kancheepuram", "Kundrathur", "Kollacheri", "taluk", "resolved", False)),
    (ask(taluk="Perambur-Purasawalkam", village="Sembium"), ("Chennai", None, None, None, "no-parent-taluk", False)),
    (ask(taluk="Coimbatore", village="Arasur"), ("Coimbatore", None, None, None, "no-parent-taluk", False)),
    (ask(registration="Sulur"), ("Coimbatore", None, None, None, "absent", False)),
    (ask(village="Otterpalayam"), ("Coimbatore", "Annur", "Otterpalayam", "state", "resolved", False)),
    (ask(village="Varadarajapuram"), (None, None, None, None, "no-parent-taluk", False)),
    (ask(taluk="Sulur", village="Karumaddambady"), ("Coimbatore", "Sulur", "Karumathampatty", "sound", "resolved", False)),
    (ask(taluk="Sulur", village="Nowhere"), ("Coimbatore", "Sulur", None, None, "unmatched", False)),
    (ask(taluk="Walajabad", village="Arasur"), ("Kancheepuram", "Walajabad", None, None, "taluk-has-no-villages", False)),
    (ask(), (None, None, None, None, "absent", False)),
]


@pytest.fixture(scope="module")
def resolved(spark):
    notices = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(CASES)], "id int, state string, district string, taluk string, village string, registration string")
    register = spark.createDataFrame(REGISTER, "district string, taluk string, village string, spoken string")
    out = O.resolved_places(notices, register, "id", ["kerala"], ["palakkad"])
    return out, notices, register


def test_ladder(resolved):
    rows = {r["id"]: r for r in resolved[0].collect()}
    assert len(rows) == len(CASES)
    for i, (given, want) in enumerate(CASES):
        r = rows[i]
        assert (r["district"], r["taluk"], r["village"], r["village_source"], r["village_status"], r["conflict"]) == want, given
    assert rows[4]["parts"] == "Pammal - I,Pammal - II"


def test_empty_tables(resolved):
    _, notices, register = resolved
    assert O.resolved_places(notices.where("false"), register, "id", ["kerala"], []).count() == 0
    assert {r["village_status"] for r in O.resolved_places(notices.where("id > 0"), register.where("false"), "id", ["kerala"], ["palakkad"]).collect()} == {"outside-state", "no-parent-taluk", "absent"}


def test_keys(spark):
    pairs = [("Thiruvallur", "Tiruvalur"), ("Pudukkottai", "Pudukotai"), ("Kancheepuram", "Kanchipuram"), ("Mannarkudi", "Mannargudi"), ("Edappadi", "Edappady"), ("Bit II", "bit 2")]
    for a, b, same in spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.place_key(F.col("a")) == P.place_key(F.col("b"))).collect():
        assert same, (a, b)
    apart = spark.createDataFrame([("G.Pappankulam", "K.Pappankulam"), ("Kengari-2", "Kengarai 1"), ("Bit I", "Bit II")], "a string, b string")
    assert apart.where(P.place_key(F.col("a")) == P.place_key(F.col("b"))).count() == 0
    heard = spark.createDataFrame([("Karmuthampatti", "karmutampati"), ("Chettipunniyam", "settibunniam"), ("aei", "a"), ("123", None)], "a string, b string")
    assert [r[0] for r in heard.select(P.sound_key(F.col("a")).eqNullSafe(P.sound_key(F.col("b")))).collect()] == [True] * 4


def test_close_finds_all(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    a = spark.createDataFrame([(str(i % 2), n) for i, n in enumerate(sorted(set(names)))], "scope string, k string")
    got = {(r["scope"], r["k"], r["key"]) for r in O.close(a, a.select("scope", F.col("k").alias("key"), F.col("k").alias("answer")), 83.0).collect()}
    rows = a.collect()
    assert got == {(x["scope"], x["k"], y["k"]) for x in rows for y in rows if x["scope"] == y["scope"] and indel_ratio(x["k"], y["k"]) >= 83.0}
