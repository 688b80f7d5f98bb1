"""Connected components of a graph given as a DataFrame of edges.

Alternates two steps until nothing changes: every node points its larger
neighbours to its least neighbour, then points its smaller ones, and itself, there
too. Both keep the number of edges, and the rounds grow with the logarithm of the
longest path. Minima are aggregated before they meet the edges, and both sides of
that join are written tables, so a node with very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.session import materialise


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``least``: the smallest neighbour of u."""
    least = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")), "cc-least")
    return edges.join(least, F.col("u") == F.col("node")).drop("node")


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.max(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: every node of ``edges`` (a, b) with the least node it reaches.

    Nodes may be of any type that has an order. Edges may repeat and go either way;
    edges with a null end and loops are left out.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(larger.alias("u"), smaller.alias("v"))
    edges = materialise(edges.distinct(), "cc-edges")
    seen = _summary(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _to_least(materialise(both, "cc-both")).filter(F.col("v") > F.col("u"))
        edges = star.select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        edges = _to_least(materialise(edges.distinct(), "cc-large"))
        others = edges.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = others.unionByName(edges.select("u", F.col("least").alias("v")))
        edges = materialise(edges.distinct(), "cc-small")
        now = _summary(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
