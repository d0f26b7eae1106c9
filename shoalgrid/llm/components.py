"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.shared import staged, unstage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` with the smallest reachable node.

    Only nodes that occur in an edge to another node are returned; loops, nulls and repeated
    edges are ignored; an empty table gives an empty result. Each round aggregates minima
    with map-side combining and joins them back, so a hub moves no neighbour list through one
    task: the join's large side is split by adaptive execution. Rounds are staged in the
    shared folder and stop when only stars around their smallest nodes are left.
    """
    now = staged(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges",
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """True if every node has one edge, to a smaller node that has none itself: only stars are left."""
    per_node = edges.groupBy("u").agg(F.count("*").alias("n"))
    if per_node.where("n > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
