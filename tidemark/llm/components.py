"""Connected components by alternating large and small stars, each round written to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_tables


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (u, v), u > v, has one edge down or some up, not both: stars around their smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    of = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not of.agg(F.max((F.col("down") + F.col("up") > 1).cast("int"))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of some undirected edges (u, v); component is its smallest node.

    Each round pulls every node towards the smallest it can reach; the number of rounds grows with the
    logarithm of the longest path. Stops as soon as the edges are stars, before the first round if they are.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_forest(now):
        later = cut(_small_star(_large_star(now)), "edges")
        drop_tables(now)
        now = later
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())
