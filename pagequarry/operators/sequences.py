"""Ordered operators: runs, as-of lookups, first and last wins, running balances.

All are window functions partitioned by document (or page), so they spread over
documents and never gather the table in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.sources.store import written


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], begins: Column, name: str = "run") -> DataFrame:
    """Number the runs of each group: ``begins`` is true where a new run starts (gaps and islands)."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    begun = F.sum(F.when(begins, 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, begun)


def asof(rows: DataFrame, rules: DataFrame, by: Sequence[str], at: str, start: str, value: str) -> DataFrame:
    """Each row with the ``value`` of the rule that has the greatest ``start`` <= ``at`` in its group.

    Rows and rules are merged in one order and the last rule is carried forward:
    one shuffle by group, no range join.
    """
    rule = rules.select(*by, F.col(start).alias(at), F.lit(0).alias("_kind"), F.struct(value).alias("_rule"), F.lit(None).cast(_row_type(rows)).alias("_row"))
    row = rows.select(*by, at, F.lit(1).alias("_kind"), F.lit(None).cast(rules.select(F.struct(value).alias("x")).schema["x"].dataType).alias("_rule"), F.struct(*rows.columns).alias("_row"))
    ordered = Window.partitionBy(*by).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = rule.unionByName(row).withColumn("_rule", F.last("_rule", ignorenulls=True).over(ordered))
    return carried.where("_kind = 1").select("_row.*", F.col(f"_rule.{value}").alias(value))


def _row_type(rows: DataFrame):
    return rows.select(F.struct(*rows.columns).alias("x")).schema["x"].dataType


def one_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group in the given order."""
    first = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def merge_revisions(entries: DataFrame) -> DataFrame:
    """Newest entry of each object: columns doc_id, rev (0 = newest), obj, gen and any others."""
    return one_per(entries, ["doc_id", "obj", "gen"], ["rev"])


def running_depth(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, closes: Column) -> DataFrame:
    """Nesting depth after each row of balanced opening and closing marks."""
    ordered = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(ordered))


def content_sections(marked: DataFrame, by: Sequence[str], order: Sequence[str], mcid: str) -> DataFrame:
    """Sections of consecutive rows with one marked-content id.

    A later run of an id replaces the earlier one but keeps the first one's place:
    columns by, mcid, place (of the first run), begin and end positions and n of the last run.
    """
    ordered = Window.partitionBy(*by).orderBy(*order)
    placed = marked.withColumn("pos", F.row_number().over(ordered)).withColumn("_last", F.lag(mcid).over(ordered))
    numbered = runs(placed, by, order, ~F.col(mcid).eqNullSafe(F.col("_last")) | (F.col("pos") == 1))
    whole = numbered.where(F.col(mcid).isNotNull()).groupBy(*by, "run", mcid).agg(
        F.min("pos").alias("begin"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n")
    )
    return whole.groupBy(*by, mcid).agg(
        F.min("run").alias("place"), *[F.max_by(c, "run").alias(c) for c in ("begin", "end", "n")]
    )


def numbered(df: DataFrame, order: Sequence[str], name: str, by: str | None = None) -> DataFrame:
    """``df`` with row numbers from 1 in the whole ``order``, or within each group of ``by``, which leads the order.

    Rows are dealt by ranges of the order; each range is numbered on its own and
    its offset added, so neither the table nor a large group meets in one task.
    """
    keys = [by, *order] if by else list(order)
    ranged = written(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    found = ranged.join(F.broadcast(offsets), "_range").withColumn(name, (own + F.col("_offset")).cast("long")).drop("_range", "_offset")
    if not by:
        return found
    firsts = found.groupBy(by).agg((F.min(name) - 1).alias("_first"))
    return found.join(firsts, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
