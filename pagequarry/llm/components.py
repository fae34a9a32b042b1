"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.store import discard, written

#: Nodes of more edges than this, or than keeps their number below ``BROADCAST_NODES``, are joined by broadcast.
HOT_EDGES = 512
BROADCAST_NODES = 1_000_000


def with_least(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of their node u, from ``low`` (u, m, degree).

    Edges of nodes of a high degree stay where they are: of ``n_edges`` edges at
    most ``2 * n_edges / bound`` nodes can have more than ``bound``, so their
    least neighbours fit a broadcast. All other edges meet by u.
    """
    bound = max(HOT_EDGES, 2 * n_edges // BROADCAST_NODES)
    hot = low.where(F.col("degree") > bound).select("u", F.col("m").alias("hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    cold = marked.where("hot IS NULL").select("u", "v").join(low.where(F.col("degree") <= bound).select("u", "m"), "u")
    return cold.select("u", "v", "m").union(marked.where("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")))


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return with_least(both.where("v > u"), low, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them.

    Links that lead to the smallest member of a bucket give no node many smaller
    neighbours; should other links do, the skewed side of this join is split at run time.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node that is not its component's smallest; ``edges`` has long columns u and v.

    Each round's edges are written to the shared folder, which cuts lineage, and
    the round before is deleted; the rounds stop when the edges (their number
    and a checksum) no longer change. An empty table has no components.
    """
    edges = written(edges.where("u <> v").distinct(), "star")
    n, seen = edges.count(), None
    while n:
        before, edges = edges, written(small_star(large_star(edges, n)), "star")
        discard(before)
        n, checksum = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, checksum) == seen:
            break
        seen = n, checksum
    return edges.select("u", F.col("v").alias("component"))
