"""Connected components of an edge table, by alternating star contractions.

Every round joins and aggregates only; a hub is met by partial aggregation and
by equi-joins whose skewed partitions adaptive execution splits. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, stored


def _towards_minimum(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star operation on edges (a > b): neighbours of a node move to the least of them."""
    around = edges.select("a", "b")
    if both_ways:
        around = around.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Dealt anew, so that both sides are shuffled for the join alone and a hub's partition can be split.
    least = least.hint("rebalance")
    moved = around.join(least, "a")
    if both_ways:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    links = moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    # The sum of decimals cannot overflow.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b; long): component is the least node reachable.

    Loops, repeated edges and edges with a null end are allowed and ignored.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _fingerprint(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        after = stored(_towards_minimum(_towards_minimum(now, True), False), "edges")
        new_mark = _fingerprint(after)
        discard(now)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
