"""Name and number trees whose nodes state the interval of their keys: checked node by node, and searched without reading them whole.

A node's ``Limits`` are an interval; its parent's must hold it and its siblings'
must lie apart in order. A look-up joins its keys with the children whose interval
holds them, level by level: of each tree only the paths to the asked keys are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import trees
from pagequarry.operators.navigation import items, text_value
from pagequarry.operators.tables import field, ref
from pagequarry.sources.store import unbroadcast, written

#: The key of a leaf's pairs, and how a key is read and compared.
NAMES, NUMBERS = "Names", "Nums"


def key_of(value: Column, pairs: str) -> Column:
    """A key as it is compared: the bytes of a name (as text), or a number."""
    return F.unhex(F.regexp_extract(value, "^s:([0-9a-f]*)$", 1)) if pairs == NAMES else value.try_cast("long")


def nodes(live: DataFrame, pairs: str) -> DataFrame:
    """Every object that can be a node: doc_id, node, kids, keys (of its pairs), values, low, high."""
    limits, listed = items(field("value", "Limits")), items(field("value", pairs))
    own = live.where(field("value", "Kids").isNotNull() | field("value", pairs).isNotNull())
    at = F.sequence(F.lit(0), F.greatest(F.expr("size(listed) div 2") - 1, F.lit(0)))
    return own.select("doc_id", F.col("obj").alias("node"), items(field("value", "Kids")).alias("kids"), F.coalesce(listed, F.array().cast("array<string>")).alias("listed"), limits.alias("limits")).select(
        "doc_id", "node", "kids", F.when(F.size("listed") > 1, F.transform(at, lambda i: F.get("listed", (i * 2).cast("int")))).otherwise(F.array().cast("array<string>")).alias("keys"),
        F.when(F.size("listed") > 1, F.transform(at, lambda i: F.get("listed", (i * 2 + 1).cast("int")))).otherwise(F.array().cast("array<string>")).alias("values"),
        F.when(F.size("limits") == 2, key_of(F.get("limits", F.lit(0)), pairs)).alias("low"), F.when(F.size("limits") == 2, key_of(F.get("limits", F.lit(1)), pairs)).alias("high"),
    )


def _links(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("node").alias("parent"), F.posexplode("kids").alias("ord", "kid")).select("doc_id", "parent", "ord", ref(F.col("kid")).alias("node"))


def problems(live: DataFrame, starts: DataFrame, pairs: str) -> DataFrame:
    """What is wrong with the trees that begin at ``starts`` (doc_id, node): doc_id, node, problem.

    ``no limits`` (below the root), ``limits reversed``, ``outside its parent``, ``overlaps the one before``,
    ``keys unsorted`` and ``keys outside the limits``.
    """
    found = written(nodes(live, pairs), "tree-nodes")
    kids = _links(found).select("doc_id", "node", "parent", F.col("ord").cast("long").alias("ord"), F.lit("").alias("name"))
    tops = starts.select("doc_id", "node", F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("name"))
    reached = trees.walk(written(kids.unionByName(tops), "tree-links"), ["doc_id"]).select("doc_id", "node", "parent", "order")
    own = reached.join(found.drop("kids", "values"), ["doc_id", "node"])
    above = found.select("doc_id", F.col("node").alias("parent"), F.col("low").alias("parent_low"), F.col("high").alias("parent_high"))
    before = Window.partitionBy("doc_id", "parent").orderBy("order")
    placed = own.join(above, ["doc_id", "parent"], "left").withColumn("last_high", F.lag("high").over(before))
    keys = F.transform("keys", lambda k: key_of(k, pairs))
    placed = placed.withColumn("keys", keys)
    unsorted = F.exists(F.sequence(F.lit(1), F.greatest(F.size("keys") - 1, F.lit(1))), lambda i: F.coalesce(F.get("keys", i) <= F.get("keys", i - 1), F.lit(False)))
    tests = {
        "no limits": F.col("parent").isNotNull() & F.col("low").isNull(),
        "limits reversed": F.col("low") > F.col("high"),
        "outside its parent": (F.least("low", "high") < F.col("parent_low")) | (F.greatest("low", "high") > F.col("parent_high")),
        "overlaps the one before": F.col("parent").isNotNull() & (F.col("low") <= F.col("last_high")),
        "keys unsorted": unsorted,
        "keys outside the limits": F.exists("keys", lambda k: (k < F.col("low")) | (k > F.col("high"))),
    }
    told = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    return placed.select("doc_id", "node", F.explode(told).alias("problem"))


def looked_up(live: DataFrame, starts: DataFrame, wanted: DataFrame, pairs: str) -> DataFrame:
    """``wanted`` (doc_id, key: as :func:`key_of` gives it) with ``value`` of the first pair that has the key, null where none has, and ``n_read``, the nodes read on its way.

    Only children whose limits hold the key, or that have none, are entered; a node on its own path is not entered again.
    """
    found = written(nodes(live, pairs), "tree-nodes")
    links = written(_links(found).join(found.select("doc_id", "node", "low", "high"), ["doc_id", "node"]), "tree-links")
    bodies = found.select("doc_id", "node", F.transform("keys", lambda k: key_of(k, pairs)).alias("keys"), "values").where("size(keys) > 0")
    level = wanted.join(starts, "doc_id").select("doc_id", "key", "node", F.array().cast("array<int>").alias("order"), F.array("node").alias("trail"))
    levels = []
    while True:
        level = written(level, "tree-lookup")
        if level.isEmpty():
            break
        levels.append(level)
        inner = level.withColumnRenamed("node", "parent").join(links, ["doc_id", "parent"])
        holds = F.coalesce((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")), F.lit(True)) & ~F.array_contains("trail", F.col("node"))
        level = inner.where(holds).select("doc_id", "key", "node", F.array_append("order", F.col("ord")).alias("order"), F.array_append("trail", F.col("node")).alias("trail"))
    every = unbroadcast(reduce(DataFrame.unionByName, levels or [level]))
    met = every.join(bodies, ["doc_id", "node"], "left")
    hit = F.array_position("keys", F.col("key"))
    own = met.groupBy("doc_id", "key").agg(
        F.min(F.when(hit > 0, F.struct("order", F.get("values", (hit - 1).cast("int")).alias("value"))))["value"].alias("value"), F.count(F.lit(1)).alias("n_read")
    )
    return wanted.join(own, ["doc_id", "key"], "left")


def names(value: Column) -> Column:
    """A looked-up name key as text."""
    return text_value(F.concat(F.lit("s:"), F.lower(F.hex(value))))
