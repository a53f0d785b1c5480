"""Connected components by alternating large-star and small-star rewiring, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One rewiring: every neighbour of u (the larger ones for large-star; the smaller ones and u for small-star) is hung on the least of them.

    The least neighbour comes from a map-side combined ``min``; groups are never collected.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(a, b)`` of longs, in any direction, loops and repeats allowed -> ``(node, root)`` with root the least node reachable.

    Nodes without an edge to another node do not appear. Each round is written to the shared folder, so lineage stays short.
    No links: no rows. A null end drops its edge.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, True), False), "stars")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = (row["n"], row["h"])
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
