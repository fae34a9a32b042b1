"""Trees kept as adjacency rows: paths, inherited values and depth-first order.

Each level is one equi-join of the frontier with its children, so the number of
joins is the tree's depth and not its size. Levels are written to the shared
folder, so none is worked out twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.sources.store import unbroadcast, written


def walk(nodes: DataFrame, by: list[str], inherit: tuple[str, ...] = (), sep: str = ".", outer: tuple[str, ...] = ()) -> DataFrame:
    """Nodes reachable from roots (null parent), with depth, path, order and inherited columns, down to any depth.

    ``nodes`` has ``by``, node, parent, ord (place among siblings), name and the
    columns of ``inherit``: null takes the parent's value; of the columns ``outer``
    the topmost value holds all the way down. ``order`` sorts depth first. A path ends where it would come back to one of its own nodes.
    """
    kids = nodes.select(*by, F.col("node"), F.col("parent"), "ord", "name", *inherit, *outer)
    level = kids.where("parent IS NULL").select(
        *by, "node", "parent", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array("ord").alias("order"), *inherit, *outer, F.array("node").alias("_trail")
    )
    levels, depth = [], 0
    while True:
        level = written(level, "tree-level")
        if depth and level.isEmpty():
            break
        levels.append(level)
        depth += 1
        up = level.select(
            *by, F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("order").alias("_order"), "_trail", *[F.col(c).alias(f"_{c}") for c in (*inherit, *outer)]
        )
        below = kids.join(up, [*by, "parent"]).where(~F.array_contains("_trail", F.col("node")))
        level = below.select(
            *by,
            "node",
            "parent",
            F.lit(depth).alias("depth"),
            F.concat_ws(sep, F.when(F.col("_path") != "", F.col("_path")), "name").alias("path"),
            F.concat("_order", F.array("ord")).alias("order"),
            *[F.coalesce(c, f"_{c}").alias(c) for c in inherit],
            *[F.coalesce(f"_{c}", c).alias(c) for c in outer],
            F.concat("_trail", F.array("node")).alias("_trail"),
        )
    return unbroadcast(reduce(DataFrame.unionByName, levels)).drop("_trail")
