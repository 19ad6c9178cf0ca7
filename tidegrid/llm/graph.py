"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the smallest node reachable.

    In each round every node points to the smallest among itself and its neighbours (a map-side minimum, so a node with very
    many links is no task of its own), pointers are followed to their ends, and links are carried over to the ends; those
    within one tree vanish.  Half of the nodes that have links or more go in each round, so all rounds together read a few
    times the links.  What a round gives is a table in the shared folder.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = stored(up.join(top, "up").select("node", "up", "top"))
            up = step.select("node", F.col("top").alias("up"))
            if step.filter("up <> top").isEmpty():
                break
        labels = stored(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        side = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"u{c}"))  # noqa: B023, E731
        moved = edges.join(side("a"), "a").join(side("b"), "b").filter("ua <> ub")
        edges = stored(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    return labels
