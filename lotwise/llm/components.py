"""Connected components of a graph given as links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(doc_id, component) for every end of the links (u, v); component is the least id it reaches.

    Each round takes the least label among a node's own and its neighbours',
    then the label of that label. Rounds end when nothing changed. Labels live
    in stored tables, so a hub joins as plain scans, which AQE can split; the
    number of rounds grows with the logarithm of a component's width.
    """
    both = stored(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("lab")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("lab").alias("near"))
        least = stored(labels.join(near, "u").select("u", F.least("lab", "near").alias("lab"), "lab").toDF("u", "lab", "was"), "least")
        ends = least.select(F.col("u").alias("at"), F.col("lab").alias("end"))
        jumped = stored(least.join(ends, F.col("lab") == F.col("at"), "left").select("u", F.least("lab", F.coalesce("end", "lab")).alias("lab"), "was"), "jumped")
        if jumped.where("lab != was").isEmpty():
            return jumped.select(F.col("u").alias("doc_id"), F.col("lab").alias("component"))
        labels = jumped.select("u", "lab")
