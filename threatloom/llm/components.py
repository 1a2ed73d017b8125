"""Connected components of a graph of document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for each node in ``links``
    (``a``, ``b``).  Least labels spread along links, then labels jump to their
    own label, so long chains halve; each round is cut from its lineage and
    only a count of changes comes to the driver."""
    both = cut(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("component")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("offer"))
        taken = labels.join(offered, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("via"))
        nxt = cut(taken.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("via", "component")).alias("component")))
        labels = nxt.drop("old")
        if nxt.where("old <> component").isEmpty():
            return labels


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (of :func:`components`) after further ``links``.  Only pairs of
    components are worked off, each once, however many links are between the two."""
    label = found.select(F.col("node"), F.col("component").alias("label"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(label.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    tops = components(cut(ends.where("a <> b").select("a", "b").distinct()))
    moved = found.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    alone = tops.join(found.select("node"), "node", "left_anti")
    return cut(moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(alone.select("node", "component")))
