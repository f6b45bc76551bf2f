"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """node, class: every node of the links (a, b) with the smallest node it is connected to; links of a node to itself are none.

    Each round hooks every node to its smallest neighbour, follows these to their roots and puts the roots in the
    place of the nodes in the links, each link once and none from a root to itself. A root that nobody hooks to has a
    smaller neighbour in the next round, so nodes at least halve in two rounds, and links go as classes close.
    Tables are written after each round and nothing is gathered. A node with very many links is a partial minimum
    per task.
    """
    edges = stored(_ordered(links))
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("class"))
        roots = _roots(stored(hooked))
        if labels is None:
            labels = roots
        else:
            up = roots.toDF("class", "root")
            labels = stored(labels.join(up, "class", "left").select("node", F.coalesce("root", "class").alias("class")))
        placed = edges.join(roots.toDF("a", "left"), "a").join(roots.toDF("b", "right"), "b")
        edges = stored(_ordered(placed.select(F.col("left").alias("a"), F.col("right").alias("b"))))
        if edges.isEmpty():
            return labels


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the smaller node first, none from a node to itself."""
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(hooked: DataFrame) -> DataFrame:
    """Nodes with the root of their tree: a node's label gives way to the label of that label until none changes."""
    while True:
        of_label = hooked.select(F.col("node").alias("class"), F.col("class").alias("root"))
        jumped = stored(hooked.join(of_label, "class").select("node", "root", F.col("class").alias("old")))
        hooked = jumped.select("node", F.col("root").alias("class"))
        if jumped.filter("root != old").isEmpty():
            return hooked
