"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Rounds after which the edges must have settled, else it is an error; each at least halves the depth.
MAX_ROUNDS = 60
#: Edges that a file of a staged round holds about: small graphs aren't written as one tiny file per shuffle partition.
FILE_EDGES = 500_000


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked with the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct().select("a", "b")


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("b"), F.col("m").alias("a")).union(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).where("a <> b").distinct().select("a", "b")


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node is a child twice, or both a child and a root: settled edges are stars around smallest nodes."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: bigint, not null); the component is its smallest node.

    Every step is a shuffle of the edges with partial minima; its result is staged in the shared folder.  Nothing is
    collected but a count and a yes or no per round.
    """
    now = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while (held := now.count()) and _unsettled(now):
        if (rounds := rounds + 1) > MAX_ROUNDS:
            raise RuntimeError(f"components are unsettled after {MAX_ROUNDS} rounds")
        after = stage(_small(_large(now)).coalesce(held // FILE_EDGES + 1), "edges")
        drop_stage(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a")).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that connect what was not connected before."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append(i)
    return out
