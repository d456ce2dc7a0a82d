"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._common import join_spread, staged


def _met(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) and the column m of ``least`` (a, m, n): the neighbours of a hub do not meet in one task."""
    return join_spread(edges, least, ["a"], "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")))
    return _met(both.filter("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    least = staged(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    across = _met(down, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the undirected ``edges`` (a, b).

    Each round is written to the shared folder. Self-loops are ignored; no edges give no rows.
    """
    now = staged(edges.filter("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        now = staged(_small_star(_large_star(now, state[0]), state[0]).filter("a <> b").distinct())
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
