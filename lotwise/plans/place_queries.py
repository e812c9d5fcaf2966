"""The place ladder over a register and notices built from the star tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import place_hints as H
from ..operators import places as P
from ..sources.scratch import stored
from ..sources.tables import table

# Nations are taluks of regions and suppliers villages, named by their keys with a
# syllable for each digit: the keys of places fold doubled digits, so that names
# with numbers such as NATION_1 and NATION_11 would be one. Each customer asks for one in one of six spellings, so
# that the SQL knows by construction where it lies.
_SPELLINGS = 6

_PLACE_SQL = """
WITH n AS (SELECT n_nationkey AS k, regexp_replace(translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'bdfklmnrst'), '(.)', '\\1a', 'g') || 'pur' AS taluk, r_name AS district FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT s_suppkey AS sk, taluk, district, regexp_replace(translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'bdfklmnrst'), '(.)', '\\1a', 'g') AS village FROM supplier JOIN n ON k = s_nationkey),
q AS (SELECT c_custkey, c_custkey % 6 AS way, s.taluk AS t, s.district AS d, s.village AS v, n.taluk AS ct, n.district AS cd, n.taluk IN (SELECT taluk FROM s) AS held FROM customer JOIN n ON k = c_nationkey JOIN s ON sk = c_custkey % 10 + 1)
SELECT c_custkey,
  CASE WHEN way = 4 THEN NULL WHEN way = 3 AND ct <> t AND d <> cd THEN cd ELSE d END AS district,
  CASE WHEN way IN (2, 4) THEN NULL WHEN way = 3 AND ct <> t AND d <> cd THEN ct ELSE t END AS taluk,
  CASE WHEN way IN (2, 4) OR way = 3 AND ct <> t AND d <> cd THEN NULL ELSE v END AS village,
  CASE WHEN way = 4 THEN NULL WHEN way = 2 THEN 'district' ELSE 'taluk' END AS district_source,
  CASE WHEN way IN (2, 4) OR way = 3 AND ct <> t AND d <> cd THEN NULL WHEN way = 3 AND ct <> t THEN 'district' ELSE 'taluk' END AS village_source,
  CASE WHEN way = 4 THEN 'outside-state' WHEN way = 2 THEN 'no-parent-taluk' WHEN way = 3 AND ct <> t AND d <> cd THEN CASE WHEN held THEN 'unmatched' ELSE 'taluk-has-no-villages' END ELSE 'resolved' END AS village_status,
  way = 3 AND d <> cd AS conflict
FROM q
"""


def _spelt(key: str):
    return F.regexp_replace(F.translate(F.col(key).cast("string"), "0123456789", "bdfklmnrst"), "(.)", "$1a")


def place_resolution(spark, sf_dir):
    """Where each customer's notice lies, in the order of the ladder."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("nation"), F.concat(_spelt("n_nationkey"), F.lit("pur")).alias("taluk"), F.col("r_name").alias("district"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), _spelt("s_suppkey").alias("village"))
    register = n.join(suppliers, "nation", "left").select("district", "taluk", "village", F.lit(None).cast("string").alias("spoken"))
    of = n.withColumnsRenamed({"taluk": "ct", "district": "cd", "nation": "c_nationkey"})
    way = F.col("c_custkey") % _SPELLINGS
    asked = table(spark, sf_dir, "customer").join(of, "c_nationkey").join(suppliers.join(n, "nation"), F.col("s_suppkey") == F.col("c_custkey") % 10 + 1)
    taluk = F.when(way == 0, F.col("taluk")).when(way == 1, F.concat(F.lower("taluk"), F.lit(" Taluk"))).when(way == 3, F.col("ct")).when(way == 4, F.col("taluk")).when(way == 5, F.concat("ct", F.lit(" Taluk, Now "), "taluk", F.lit(" Taluk")))
    notices = asked.select("c_custkey", F.when(way == 4, "Kerala").alias("state"), "district", taluk.alias("taluk"), "village", F.lit(None).cast("string").alias("registration"))
    return P.resolved_places(notices, register, "c_custkey", ["kerala"], []).drop("parts")


# Villages and taluks are named by letters of a digest of their keys, so that no two
# are near; every fourth village lies in a second taluk too. Each customer says what
# only one hint can use, in one of twelve ways, so that the SQL knows the answer.
_WAYS = 12
_LETTERS = "translate(substr(md5({0}), 1, {1}), '0123456789abcdef', 'bdklmnrsbdklmnrs')"


def _sql_name(kind: str, key: str, n: int) -> str:
    return "regexp_replace(" + _LETTERS.format(f"'{kind}' || {key}", n) + ", '(.)', '\\1a', 'g')"


_HINTS_SQL = f"""
WITH n AS (SELECT n_nationkey AS k, {_sql_name('n', 'n_nationkey', 8)} || 'pur' AS taluk, r_name AS district, r_regionkey IN (0, 1) AS metro, n_nationkey % 3 <> 0 AS core FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT s_suppkey AS sk, s_nationkey AS k, {_sql_name('v', 's_suppkey', 14)} AS village FROM supplier),
reg AS (SELECT sk, k, village FROM s UNION ALL SELECT sk, (k + 5) % 25, village FROM s WHERE sk % 4 = 0),
place AS (SELECT reg.*, taluk, district, metro, core FROM reg JOIN n USING (k)),
held AS (SELECT DISTINCT k FROM reg),
wide AS (SELECT sk, district, count(*) AS c, min(taluk) AS taluk FROM place GROUP BY 1, 2),
one_metro AS (SELECT sk, min(taluk) AS taluk, min(district) AS district FROM place WHERE metro GROUP BY 1 HAVING count(*) = 1 AND bool_and(core)),
parts AS (SELECT k, sk % 2 AS half, string_agg(village, ',' ORDER BY village) AS parts FROM s GROUP BY 1, 2),
q AS (SELECT c_custkey, c_custkey % 12 AS way, s.sk, s.k, s.village AS v, a.taluk AS t, a.district AS d, a.metro AS in_metro, b.k AS k2, b.taluk AS t2, b.district AS d2, c.k AS k3, c.taluk AS t3, c.district AS d3, c.metro AS metro3,
    s.sk % 4 = 0 AS twin, b.k IN (SELECT k FROM held) AS held2, c.k IN (SELECT k FROM held) AS held3
  FROM customer JOIN s ON s.sk = c_custkey % (SELECT count(*) FROM supplier) + 1 JOIN n a ON a.k = s.k JOIN n b ON b.k = (s.k + 5) % 25 JOIN n c ON c.k = (s.k + 1) % 25),
f AS (SELECT q.*, w.c AS in_district, w3.c AS in_third, w3.taluk AS third, m.taluk AS mt, m.district AS md, CASE way WHEN 8 THEN metro3 ELSE in_metro END AND m.sk IS NOT NULL AS by_metro, parts
  FROM q JOIN wide w ON w.sk = q.sk AND w.district = d LEFT JOIN wide w3 ON w3.sk = q.sk AND w3.district = d3 LEFT JOIN one_metro m ON m.sk = q.sk LEFT JOIN parts p ON p.k = q.k AND half = q.sk % 2),
office AS (SELECT k FROM f WHERE way < 2 OR way = 2 AND by_metro GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT *, CASE
    WHEN way = 0 THEN 'city-taluk' WHEN way = 1 THEN 'pin-taluk'
    WHEN way = 2 AND by_metro THEN 'metro-unique' WHEN way = 2 AND k IN (SELECT k FROM office) THEN 'sro-taluk'
    WHEN way = 3 AND NOT (twin AND d2 = d) THEN 'city-taluk'
    WHEN way = 4 AND in_district = 1 THEN 'district-sound' WHEN way = 5 AND in_district = 1 THEN 'district-fuzzy'
    WHEN way = 6 THEN 'village-pieces'
    WHEN way = 7 AND twin THEN 'taluk' WHEN way = 7 AND held2 AND d = d2 THEN 'neighbour-taluk'
    WHEN way = 8 AND in_third = 1 THEN 'district' WHEN way = 8 AND held3 AND by_metro THEN 'metro-unique'
    WHEN way = 9 THEN 'gram-panchayat'
    WHEN way = 10 AND (sk % 3 = 0 OR in_district = 1) THEN 'census-2011'
    WHEN way = 11 AND by_metro THEN 'metro-unique' WHEN way = 11 THEN 'lgd-town' END AS source FROM f)
SELECT c_custkey,
  CASE WHEN source = 'metro-unique' THEN md WHEN way = 7 AND (source IS NULL OR twin) THEN d2 WHEN way = 8 THEN d3 ELSE d END AS district,
  CASE WHEN source = 'metro-unique' THEN mt WHEN way = 7 AND (source IS NULL OR twin) THEN t2 WHEN way = 8 THEN CASE WHEN source = 'district' THEN third ELSE t3 END WHEN source IS NOT NULL THEN t END AS taluk,
  CASE WHEN source <> 'gram-panchayat' THEN v END AS village, CASE WHEN way = 9 THEN parts END AS parts, source AS village_source,
  CASE WHEN way = 9 THEN 'one-of-parts' WHEN source IS NOT NULL THEN 'resolved' WHEN way = 7 THEN CASE WHEN held2 THEN 'unmatched' ELSE 'taluk-has-no-villages' END WHEN way = 8 THEN CASE WHEN held3 THEN 'unmatched' ELSE 'taluk-has-no-villages' END ELSE 'no-parent-taluk' END AS village_status
FROM r
"""


def _named(kind: str, key: str, n: int):
    letters = F.translate(F.substring(F.md5(F.concat(F.lit(kind), F.col(key).cast("string"))), 1, n), "0123456789abcdef", "bdklmnrsbdklmnrs")
    return F.regexp_replace(letters, "(.)", "$1a")


def notices_with_hints(spark, sf_dir):
    """Where notices lie that leave the taluk open or name a wrong one, by ten hints and what placed notices teach."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("k"), F.concat(_named("n", "n_nationkey", 8), F.lit("pur")).alias("taluk"), F.col("r_name").alias("district"), "r_regionkey")
    n = stored(n, "taluks")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("k"), _named("v", "s_suppkey", 14).alias("village"))
    places = suppliers.union(suppliers.where("sk % 4 = 0").withColumn("k", (F.col("k") + 5) % 25))
    register = stored(n.join(places, "k", "left").select("district", "taluk", "village", F.lit(None).cast("string").alias("spoken")), "register")
    own = stored(suppliers.join(n, "k"), "own")
    near = n.select(((F.col("k") + 5) % 25).alias("k2"), "taluk").join(n.select(F.col("k").alias("k2"), F.col("taluk").alias("other")), "k2").select("taluk", "other")
    hints = H.Hints(
        pins=n.select((F.col("k") + 600000).cast("string").alias("pin"), "taluk"),
        neighbours=near.union(near.select("other", "taluk")),
        panchayats=own.withColumn("_p", F.col("k") * 2 + F.col("sk") % 2).select("taluk", _named("p", "_p", 10).alias("panchayat"), "village"),
        lineage=own.select(_named("o", "r_regionkey", 10).alias("old"), F.when(F.col("sk") % 3 == 0, F.col("village")).alias("village"), "taluk", F.col("village").alias("now")).unionByName(n.select(_named("o", "r_regionkey", 10).alias("old"), F.lit(None).cast("string").alias("village"), "taluk", F.lit(None).cast("string").alias("now"))),
        towns=n.select(_named("t", "k", 10).alias("town"), F.lit("municipality").alias("kind"), "district", "taluk"),
        metro=tuple(r[0] for r in table(spark, sf_dir, "region").where("r_regionkey IN (0, 1)").select("r_name").collect()),
        core=tuple(r[0] for r in n.where("k % 3 <> 0").select("taluk").collect()),
    )
    total = suppliers.count()
    way, later = F.col("c_custkey") % _WAYS, n.select("k", F.col("taluk").alias("taluk3"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % total + 1).alias("sk")).join(own, "sk").withColumns({"k2": (F.col("k") + 5) % 25, "k3": (F.col("k") + 1) % 25, "_p": F.col("k") * 2 + F.col("sk") % 2})
    asked = asked.join(n.select(F.col("k").alias("k2"), F.col("taluk").alias("taluk2")), "k2").join(later.withColumnRenamed("k", "k3"), "k3")
    v = F.col("village")
    notices = asked.select(
        "c_custkey",
        F.lit(None).cast("string").alias("state"),
        F.when(way.isin(0, 1, 2, 3, 4, 5, 10, 11), F.col("district")).alias("district"),
        F.when(way.isin(6, 9), F.col("taluk")).when(way == 7, F.col("taluk2")).when(way == 8, F.col("taluk3")).when(way == 10, _named("o", "r_regionkey", 10)).alias("taluk"),
        F.when(way == 4, F.replace(v, F.lit("a"), F.lit("ah"))).when(way.isin(5, 7), F.concat(v, F.lit("m"))).when(way == 6, F.concat(v, F.lit(" Town and Gandhi Street"))).when(way == 9, "Nowhere Palayam").otherwise(v).alias("village"),
        F.when(way < 2, F.concat("taluk", F.lit(" Joint-II SRO"))).when(way == 2, F.concat("taluk", F.lit(" S.R.O."))).alias("registration"),
        F.when(way.isin(0, 3), F.concat("taluk", F.lit(" Town"))).alias("city"),
        F.when(way == 1, (F.col("k") + 600000).cast("string")).when(way == 3, (F.col("k2") + 600000).cast("string")).alias("pin"),
        F.when(way == 9, F.concat(_named("p", "_p", 10), F.lit(" Panchayat"))).alias("panchayat"),
        F.when(way == 11, F.concat(F.lit("House at "), _named("t", "k", 10), F.lit(" Municipality, Town and Country Planning approved"))).alias("text"),
    )
    notices = stored(notices, "notices")
    resolved = P.resolved_places(notices, register, "c_custkey", [], [])
    return H.hinted_places(resolved, notices, register, "c_custkey", hints).drop("district_source", "conflict", "town", "town_kind")


Q, SQL = {"place_resolution": place_resolution, "notices_with_hints": notices_with_hints}, {"place_resolution": _PLACE_SQL, "notices_with_hints": _HINTS_SQL}
