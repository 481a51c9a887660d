"""Connected components by alternating star contraction, with joins and aggregates only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, with_class


def _starred(edges: DataFrame, total: int, moved: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What moved() makes of edges (u, v) with m, the smallest v of each u, as a table; a hub's edges are spread over tasks. The
    smallest lie in a table too: the join reads them three times, and plans stay small."""
    low = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies")), "lows")
    out = saved(moved(with_class(edges, low, ["u"], total).select("u", "v", "m")).distinct(), "edges")
    forget(low)
    return out


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lower = F.least("u", "m")
    return _starred(both, 2 * total, lambda x: x.withColumn("m", lower).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    return _starred(edges, total, lambda x: x.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """True if each node has one edge down and none up, or edges up alone: then all components are stars around their smallest ids."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id reachable. Ids without links are absent; an empty input gives no rows.

    Each round is two joins of the edges with one row per node, so a hub costs one row for each of its edges and no list of
    neighbours is ever built; the rows of large hubs are dealt over tasks. Rounds grow with the logarithm of the longest path; links
    that are stars already need none."""
    edges = saved(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    total = edges.count()
    for _ in range(most_rounds):
        if _stars(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        half, before = _large_star(edges, total), edges
        edges = _small_star(half, total)
        forget(before, half)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
