"""Connected components by alternating stars, with Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the least vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the least vertex of the component of every vertex that has an edge.

    ``edges``: long columns a and b, a different from b. Each round is written to the shared
    checkpoint folder; the rounds end when one changes nothing.
    """
    edges = checkpoint(edges.select("a", "b").distinct())
    state = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state or not sums[0]:
            break
        state = tuple(sums)
        edges = checkpoint(_small(_large(edges)).distinct())
    found = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct())
