"""Connected components of an edge table by alternating large and small stars.

Each round is two joins and aggregations over the edges, written to the shared folder; rounds grow
with the logarithm of the longest path. A hub with very many edges is pre-aggregated where only
its minimum is needed, and split by Spark's skew join where its edges are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.sources.shared import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (larger ones only, or smaller ones and itself) to the smallest neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    side = both.where("b > a") if large else both.where("b < a")
    linked = side.join(least, "a").select(F.col("b"), F.col("least").alias("a"))
    if not large:
        linked = linked.unionAll(least.select(F.col("a").alias("b"), F.col("least").alias("a")))
    return linked.where("a != b").select("a", "b").distinct()


def components(edges: DataFrame, paths: list[str], most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge. Columns of `edges`: a, b."""
    now = settle(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", paths)
    for _ in range(most_rounds):
        large = settle(_star(now, True), "large", paths)
        small = settle(_star(large, False), "small", paths)
        # done when every edge hangs on a root: no id is both a parent and a child, or a child twice
        children = small.groupBy("b").agg(F.count("*").alias("n"))
        twice = children.where("n > 1").limit(1).count()
        inner = small.select("a").distinct().join(children.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        now = small
        if not twice and not inner:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )
