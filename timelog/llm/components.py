"""Connected components by alternating large-star and small-star contraction.

Every round is joins and aggregates on edges, so no vertex set meets in one
task; a hub's rows are a skewed join side, which adaptive execution splits.
Each round is written to the shared folder, which cuts lineage and survives
the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Neighbours above a vertex join the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    # An edge (small, large): as seen from each end, what lies above that end moves to that end's least neighbour.
    up = edges.join(least, F.col("u") == F.col("x")).select(F.col("m").alias("u"), "v")
    return up.where("u < v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its lower neighbours join the least of those."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "x")
    moved = edges.join(least, F.col("v") == F.col("x"))
    lower = moved.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return lower.union(least.select(F.col("m").alias("u"), F.col("x").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) long links, u < v -> (node, root): every linked vertex with the least vertex it reaches.

    No edges give an empty table; `discard` deletes it. Runs until a round leaves the edges as they
    were: then each vertex points straight at its root.
    """
    now = stored(edges.select("u", "v").where("u < v").distinct())
    sign = None
    while True:
        then = stored(_small(_large(now)))
        mark = tuple(then.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        discard(now)
        now = then
        if mark == sign:
            out = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            out._timelog_path = now._timelog_path
            return out
        sign = mark
