"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join, so a node with very many neighbours is
split like any other skewed join key. Edges live in tables of the shared folder;
the driver only sees two numbers a round, to notice that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them. Here u > v always."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges of any order -> (node, root) for each node that has an edge; root is its component's least node."""
    e = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    state = _state(e)
    for _ in range(rounds if state[0] else 0):
        after = save(_small_star(_large_star(e)), "cc")
        forget(e)
        e, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
