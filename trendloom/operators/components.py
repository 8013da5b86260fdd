"""Connected components of a graph given as a table of edges, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes, in a number of rounds that grows with the
    logarithm of the nodes. Each round is written to the shared folder, and the one before deleted. Null ends and loops are left out.
    """
    with Workspace(edges.sparkSession, "components") as space:
        now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        now, before = space.written(now, "edges"), None
        for r in range(max_rounds):
            last, now = now, space.written(_small_star(_large_star(now)), f"stars-{r}")
            space.drop(last)
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                return space.finish(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                    now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
            before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
