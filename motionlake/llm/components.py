"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import materialize


def _print(edges: DataFrame) -> tuple:
    """Size and order-free hash of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, below the smallest neighbour. Both
    steps are a grouped minimum and an equi-join, so a hub is pre-aggregated in the map tasks and
    its join partition can be split. Rounds grow with the logarithm of the longest path.
    An empty table gives an empty result; self-links are ignored.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e = materialize(e)
    seen = _print(e)
    if not seen[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = materialize(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        if (now := _print(e)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
