"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of all nodes of the edges ``u``, ``v``.

    Edges may repeat and point either way; loops and nulls are left out, and so are
    nodes without another edge.  A node's edges are aggregated before they are
    shuffled, and the joins back to them may be split, so a node with very many
    edges is no bottleneck.  The number of rounds grows with the logarithm of the
    graph's diameter.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges).distinct()).where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tied.union(tied.select("component", "component").distinct())
