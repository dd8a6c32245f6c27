"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _fingerprint(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return got.n, got.x


def components(work: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node that it reaches) for every node of edges(a, b) that has a root other than itself.

    In a large star each node hands its greater neighbours the least neighbour, in a small star its lesser
    ones; both shrink distances to the root geometrically.  The least neighbour is a partial aggregate, and
    it is written before it is joined back, so that a node with very many neighbours is a skewed join that
    adaptive execution splits.  Nothing but a count and a checksum reaches the driver.  Loops and repeated
    edges do no harm; nulls are dropped; no edges give no rows.
    """
    now = work.write(edges.dropna().filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars-0")
    said = _fingerprint(now)
    if not said[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), f"large-{k}")
        large = work.write(now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            # a node whose least neighbour is lesser than itself keeps that one link
            least.filter("least < u").select("u", F.col("least").alias("v"))
        ).distinct(), f"linked-{k}")
        least = work.write(large.groupBy("u").agg(F.min("v").alias("least")), f"small-{k}")
        small = large.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        after = work.write(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), f"stars-{k}")
        for name in (f"large-{k}", f"linked-{k}", f"small-{k}", f"stars-{k - 1}"):
            work.drop(name)
        now, before, said = after, said, _fingerprint(after)
        if said == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
