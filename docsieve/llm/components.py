"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, join_groups


def _least(pairs: DataFrame, *more: F.Column) -> DataFrame:
    """(u, m, n) of each u: its smallest v and how many rows it has."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), *more)


def connected(edges: DataFrame, space: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge to another, with the smallest node reachable from it.

    Every round rewires each node's neighbours to the smallest of them, first the larger ones, then the smaller ones, and
    writes the new edges; it ends when all edges lead to roots, after a number of rounds logarithmic in the longest path.
    What several joins of a round read is written, so that its plans, and what the driver holds of them, stay small.
    Nulls and loops are left out; repeated edges count once.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, turn = space.keep(pairs.distinct(), "stars0"), 0
    while True:
        # edges lead from the larger to the smaller node
        both = now.select("u", "v", F.lit(1).alias("up")).union(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        nodes = space.keep(_least(both, F.sum("up").alias("ups")), f"nodes{turn}")
        if nodes.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("ups") < F.col("n")))).isEmpty():
            break
        total = 2 * now.count()
        # a hub's neighbours, which may be a third of all nodes, don't meet in one task
        least = nodes.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
        large = space.keep(join_groups(now, least, ["v"], "n", total, written=True).select("u", F.col("m").alias("v")).distinct(), f"large{turn}")
        least = space.keep(_least(large), f"least{turn}")
        small = join_groups(large, least, ["u"], "n", total, written=True).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        now = space.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"stars{turn}")
        for table in ("stars", "nodes", "large", "least"):
            space.drop(f"{table}{turn - 1}")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
