"""Connected components of an edge list, by alternating star steps.

Each step is an aggregate and a join on a node; a node with very many neighbours is reduced by
partial aggregates and split by Spark's adaptive skew join. Steps are written to the shared
folder, so lineage stays short and a lost executor costs one step. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.sources.tables import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the least node it reaches.

    Loops and repeated edges do no harm; an edge with a null end is left out.
    """
    e = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.lit(0).alias("z")
    )
    e = stage(e.filter("u != v").dropna().select("u", "v").distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v").distinct()
            )
        before = now
        e = stage(_small_star(_large_star(e)), "edges")


def _large_star(e: DataFrame) -> DataFrame:
    """Greater neighbours of each node move to the least node around it."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = both.filter("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours move to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
