"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b) that is not its own root.

    A round relinks all neighbours of a node to the smallest among them, first the larger ones, then the smaller; rounds
    go on until nothing changes, about the logarithm of the longest path. Minima are combined in map tasks, so a node
    with a third of all links is no hot group; each round is written to the shared folder.
    """
    edges = written(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(_down(small.select("e.*")), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    onward = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(onward).isEmpty()


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return (edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
