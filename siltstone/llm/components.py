"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import materialize, release


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for all nodes of (a, b) edges, root the smallest node reachable; isolated nodes do not occur.

    Each round writes the edges to shared storage; the number of rounds grows with the logarithm of the
    longest path. Stars of any size are aggregated before the shuffle, and the join back is split by AQE. Callers give
    few edges for a node (one to each round's partner), and those of components already found only between their roots.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        at = both.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))
        if large:
            out = at.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            lower = at.where(F.col("v") < F.col("u"))
            out = lower.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lower.select(F.col("u"), F.col("m")))
        return out.where("a <> b").distinct()

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = digest(edges)
    for _ in range(rounds if before[0] else 0):
        old, edges = edges, materialize(star(star(edges, True), False), "edges")
        release(edges.sparkSession, old)
        now = digest(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def roots_of(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of a forest (node, up) in which each node stands once and roots are their own parents, by pointer jumping.

    Each round halves the depth, is one join and is written.
    """
    parents = materialize(parents.select("node", "up", F.lit(True).alias("moved")), "parents")
    for _ in range(rounds):
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        old, parents = parents, materialize(parents.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
        release(parents.sparkSession, old)
        if parents.where("moved").isEmpty():
            return parents.select("node", F.col("up").alias("root"))
    raise RuntimeError(f"the forest is deeper than 2^{rounds}")
