"""Connected components of an edge table, by alternating large and small stars.

Each round points the neighbours of every node to its smallest neighbour: first those larger than the node, then those
smaller. Rounds are two aggregations and joins over the edges, whose number never grows; they end when the edges are
stars, after about log2 of the longest chain, which one aggregation over the nodes tells. A node with very many neighbours is only a key of a ``min`` that is
combined on the map side, and of a join whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.storage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: a > b. For each node, its neighbours (the larger or the smaller ones) move to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = pairs.union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0] is not True


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component``: the smallest node it is connected with. Nodes without an edge are absent."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    edges = cut(edges)
    while not _stars(edges):
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
