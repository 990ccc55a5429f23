"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small, written


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and root (its component's least node) of every node of edges (a, b) but the roots themselves.

    Each round is two grouped minima and two joins; edges and minima lie in the shared folder between steps. Minima are
    summed up per task first. They are written before the joins, so that a node with very many edges has both sides
    of its join in files of their own and the adaptive skew join splits it (few minima, two numbers a row, are broadcast)."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.filter("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), "edges")
        forget(e, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(small(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        forget(large, least)
        before, state = state, _state(e)
        if before == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("the components did not settle")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
