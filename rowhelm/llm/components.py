"""Connected components of a table of links, by repeated star contraction in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import drop_stored, stored


def connected(links: DataFrame, alone: bool = True) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b: long): root is the smallest node it reaches.

    Each round hangs every node's larger neighbours, then the node itself and its smaller ones, on
    the smallest of them; the rounds needed grow with the logarithm of the longest path. A node's
    neighbours are never gathered: their smallest is an aggregate that is joined back. Links with a
    null end are left out. The result has no links of a node to itself but one row for each node; without
    ``alone``, nodes that are linked to no other are left out and ``links`` are read once.
    """
    edges = stored(
        links.filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
        free=False,
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # now each node with its smaller neighbours
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "stars", free=False)
        drop_stored(last)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not alone:
        return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    nodes = links.select("a").union(links.select("b")).distinct().filter("a is not null").withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each upper node has one link, to a node that is nobody's upper one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ends.filter("up > 1 or (up = 1 and least = 0)").limit(1).count() == 0
