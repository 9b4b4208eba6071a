"""Connected components of a graph in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import packed, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a, b); a component is
    named by its smallest node.

    Alternates two steps until nothing changes: link each node's larger
    neighbours, then its smaller ones, to the smallest of them.  The smallest
    neighbour is a partial aggregate, and a node with very many neighbours is
    split by the skewed join; each round is written to the shared folder.
    """
    edges, _, tasks = packed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large, _, tasks = packed(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                                 .coalesce(tasks).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").select(F.col("b").alias("x"), "a", "low"))
        linked = (small.filter("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b"))
                  .unionByName(least.select("a", F.col("low").alias("b"))).coalesce(tasks).distinct())
        linked, _, tasks = packed(linked)
        changed = _within(linked, edges) and _within(edges, linked)
        edges = linked
        del both, least, large, small, linked
        release(edges.sparkSession)
        if changed:
            break
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).coalesce(tasks).distinct())


def _within(some: DataFrame, every: DataFrame) -> bool:
    return some.join(every, ["a", "b"], "left_anti").isEmpty()
