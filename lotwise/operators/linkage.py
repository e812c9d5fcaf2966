"""Record linkage: blocking, assignment, components, merge proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def block_pairs(rows: DataFrame, block: list[str], key: str, condition: Column | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of rows that agree on the block columns; a null never agrees. ``condition`` speaks of a.* and b.*."""
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{key}") < F.col(f"b.{key}")
    for c in block:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on if condition is None else on & condition).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


#: Members of a class that travel as one array, about.
MEMBERS = 256


def pairs_of_classes(similar: DataFrame, members: DataFrame, store) -> DataFrame:
    """(a, b, and what ``similar`` says), a < b: all pairs of members of the classes of ``similar``.

    ``similar``: class_a, class_b and more columns, a class with itself too;
    ``members``: class, n (the class's members) and key. Members are dealt into
    arrays of about ``MEMBERS``, and pairs of arrays into tasks by these, so that
    no class's pairs are one task's. ``store`` writes a table and reads it back.
    """
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / MEMBERS)).alias("part")
    dealt = store(members.select("class", "key", part).groupBy("class", "part").agg(F.collect_list("key").alias("keys")))
    side = lambda x: dealt.select(F.col("class").alias(f"class_{x}"), F.col("part").alias(f"part_{x}"))
    keys = lambda x: dealt.select(F.col("class").alias(f"class_{x}"), F.col("part").alias(f"part_{x}"), F.col("keys").alias(f"keys_{x}"))
    own = F.col("class_a") == F.col("class_b")
    met = similar.join(side("a"), "class_a").join(side("b"), "class_b").where(~own | (F.col("part_a") <= F.col("part_b")))
    met = met.join(keys("a"), ["class_a", "part_a"]).join(keys("b"), ["class_b", "part_b"])
    once = F.when(own & (F.col("part_a") == F.col("part_b")), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    said = [c for c in similar.columns if c not in ("class_a", "class_b")]
    each = met.withColumn("x", F.explode("keys_a")).withColumn("y", F.explode("keys_b")).where(once)
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *said)


def assign(candidates: DataFrame, left: str, right: str) -> DataFrame:
    """Of candidates (left, right, reason), those where each side has one partner; others are reviews with a cause."""
    n_left, n_right = F.count("*").over(Window.partitionBy(left)), F.count("*").over(Window.partitionBy(right))
    return candidates.select(left, right, "reason", n_left.alias("of_left"), n_right.alias("of_right")).withColumn("verdict", F.when((F.col("of_left") == 1) & (F.col("of_right") == 1), "link").when(F.col("of_right") > 1, "contested").otherwise("split")).drop("of_left", "of_right")


def lots_to_listings(listings: DataFrame, lots: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(listing, lot, reason): the single lot; else the lot of equal price; else that within the tolerance; only one-to-one answers.

    ``listings``: doc, listing, price; ``lots``: doc, lot, price. Steps are
    separate candidate sets; a later one takes listings that no earlier did.
    """
    counts = lots.groupBy("doc").agg(F.count("*").alias("n_lots"))
    all_ = listings.join(lots.withColumnRenamed("price", "lot_price"), "doc").join(counts, "doc")
    near = F.abs(F.col("price") - F.col("lot_price")) <= tolerance * F.abs(F.col("lot_price"))
    reason = F.when(F.col("n_lots") == 1, "single_lot").when(F.col("price") == F.col("lot_price"), "reserve").when(near, "reserve_near")
    step = F.when(F.col("reason") == "single_lot", 0).when(F.col("reason") == "reserve", 1).otherwise(2)
    judged = all_.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("step", step)
    first = judged.withColumn("best", F.min("step").over(Window.partitionBy("listing"))).where("step = best")
    only = first.withColumn("mine", F.count("*").over(Window.partitionBy("listing"))).withColumn("theirs", F.count("*").over(Window.partitionBy("lot", "doc")))
    return only.where((F.col("mine") == 1) & ((F.col("theirs") == 1) | (F.col("reason") == "single_lot"))).select("listing", "doc", "lot", "reason")


def components(links: DataFrame, store, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over links, by rounds that contract the graph.

    In a round each id goes to that of itself and its neighbours which comes first
    in the round's own random order, and links between what is left go on, so that
    a constant share of the ids is gone with each round and all rounds together
    move a few times the links. ``store`` writes a table and reads it back, so that
    each round is a plain scan.
    """
    some = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    edges = store(some.unionByName(some.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("id"))
        steps.append(store(edges.groupBy("u").agg(F.min(ranked("v")).alias("near")).select("u", F.least(ranked("u"), "near")["id"].alias("to"))))
        to = steps[-1]
        moved = edges.join(to, "u").select("v", F.col("to").alias("_u")).join(to.withColumnRenamed("u", "v"), "v").select(F.col("_u").alias("u"), F.col("to").alias("v"))
        edges = store(moved.where("u != v").distinct())
    ends = steps.pop()
    while steps:
        # what a round left has its end from those after it
        ends = steps.pop().join(ends.toDF("at", "end"), F.col("to") == F.col("at"), "left").select("u", F.coalesce("end", "to").alias("to"))
        ends = store(ends)
    least = ends.groupBy("to").agg(F.min("u").alias("component"))
    return ends.join(least, "to").select(F.col("u").alias("id"), "component")


def cluster_grades(members: DataFrame, links: DataFrame) -> DataFrame:
    """Size and confidence of clusters: CONFIRMED if all links are, else PROBABLE; SINGLE without links. members: (id, component)."""
    graded = links.join(members.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.bool_and(F.col("confidence") == "CONFIRMED").alias("all_confirmed"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.join(graded, "component", "left").select("component", "size", F.when(F.col("size") == 1, "SINGLE").when(F.col("all_confirmed"), "CONFIRMED").otherwise("PROBABLE").alias("confidence"))


def name_groups(rows: DataFrame, name: str, key: Column) -> DataFrame:
    """Names with one key, with the most frequent as label (then not all upper case, then longest, then first by name)."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).withColumn("key", key)
    order = Window.partitionBy("key").orderBy(F.desc("n"), F.col("name") == F.upper("name"), F.desc(F.length("name")), "name")
    return counts.withColumn("label", F.first("name").over(order)).select("name", "n", "key", "label")


def place_by_steps(rows: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], answer: str, key: str) -> DataFrame:
    """A ladder: each step joins on its columns and answers only where the join gives exactly one answer; the first that does wins.

    Returns key, the answer and the step's name as source.
    """
    out = rows
    names = []
    for name, table, on in steps:
        one = table.groupBy(*on).agg(F.min(answer).alias(f"_{name}"), F.countDistinct(answer).alias("_n")).where("_n = 1").drop("_n")
        out = out.join(one, on, "left")
        names.append(name)
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names])
    return out.select(key, F.coalesce(*[F.col(f"_{n}") for n in names]).alias(answer), source.alias("source"))
