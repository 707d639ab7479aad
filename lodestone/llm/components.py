"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import uneven_join, written


def _sum(edges: DataFrame) -> tuple:
    """A figure that stays only if the edges stay: they are distinct, so count and hash sums tell."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, name: str) -> DataFrame:
    """u, m (its least v) and n (its edges), written; minima are combined before the shuffle."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges (u long, v long; null and u = v are ignored).

    Alternates the large-star and small-star steps until nothing changes: stars of a path halve in height each
    time, so the rounds grow with the logarithm of a component's diameter. Each step's table is written to the
    shared folder. A node with very many neighbours costs its edges once, and they don't meet in one task: the
    least neighbours of such nodes are broadcast to them.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _sum(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = uneven_join(both, _least(both, "least"), "u", "n", 2 * state[0]).where("v > u")
        large = joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        # small star: every smaller neighbour of a node, and the node, go to the least of them
        least = _least(large, "least")
        linked = uneven_join(large, least, "u", "n", least.agg(F.sum("n")).first()[0] or 0)
        nxt = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(nxt, "small-star")
        before, state, now = state, _sum(nxt), nxt
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return members.unionByName(roots.select("node", F.col("node").alias("root")))
