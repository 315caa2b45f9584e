"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stage_table


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: no node has two edges to lesser nodes, or edges both to lesser and to greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs to (node, root) for each node of an edge; root is the least node of its component.

    Each step hangs the neighbours of a node on the least of them, until every component is a star. Minima are
    aggregated before the shuffle, so that a node with many neighbours is no burden to one task. Steps go on as long as
    any component is not a star; no node's least neighbour ever grows, so they end.
    """
    edges = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _nearest(both).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        least = _nearest(large)
        small = large.join(least, "a").select(F.col("b").alias("x"), "least").where("x <> least").select(F.col("x").alias("a"), F.col("least").alias("b"))
        edges = stage_table(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "edges")
    roots = edges.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("node"), "root"))
