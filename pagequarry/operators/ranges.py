"""Range and spatial joins as equi-joins on buckets of several sizes.

Without a key in common Spark pairs every row with every other; these helpers
give both sides buckets and join on them. A range or rectangle lies in the few
buckets of the level whose size fits it, however large it is; the other side
looks in its buckets of every level that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(extent: Column, size: float) -> Column:
    """The least level whose buckets, ``size`` times a power of two, are at least as long as ``extent``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(size)) / size)).cast("int"))


def _levels(rows: DataFrame) -> Column:
    """The levels that occur, as a literal array: at most the logarithm of the largest extent."""
    found = sorted(r["level"] for r in rows.select("level").where("level IS NOT NULL").distinct().collect())
    return F.array(*[F.lit(k) for k in found]).cast("array<int>")


def _step(level: Column, size: float) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(2.0), level)


def range_lookup(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points with every range ``low <= at <= high``; a range lies in at most two buckets of its level."""
    leveled = ranges.where(F.col(low) <= F.col(high)).withColumn("level", _level((F.col(high) - F.col(low)).cast("double"), bucket))
    step = _step(F.col("level"), bucket)
    spread = leveled.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))).withColumnRenamed("level", "_level")
    keyed = points.withColumn("_level", F.explode(_levels(leveled))).withColumn("_b", F.floor(F.col(at) / _step(F.col("_level"), bucket)))
    return keyed.join(spread, ["_level", "_b"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_b")


def _cells(r: Column, step: Column) -> Column:
    """Grid cells that a rectangle touches, as an array of structs."""

    def steps(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / step), F.floor(b / step))

    return F.flatten(
        F.transform(steps(r[0], r[2]), lambda x: F.transform(steps(r[1], r[3]), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )


def spatial_pairs(rects: DataFrame, by: list[str], node: str, rect: str, size: float = 50.0) -> DataFrame:
    """Pairs (a < b) of rectangles of one group that touch, by grids of ``size`` units and its doubles.

    The larger rectangle of a pair lies in at most four cells of its level, and
    the smaller one looks there. A pair is produced only in the first cell that
    both touch, so nothing is made twice and no de-duplicating shuffle follows.
    """
    r = F.col(rect)
    leveled = rects.select(*by, F.col(node).alias("node"), r.alias("r"), _level(F.greatest(r[2] - r[0], r[3] - r[1]), size).alias("level"))
    step = _step(F.col("at"), size)
    home = leveled.withColumn("at", F.col("level")).select(*by, "at", F.explode(_cells(F.col("r"), step)).alias("cell"), F.col("node").alias("a"), F.col("r").alias("ra"))
    looks = leveled.withColumn("at", F.explode(_levels(leveled))).where("at >= level")
    seen = looks.select(*by, "at", F.explode(_cells(F.col("r"), step)).alias("cell"), F.col("node").alias("b"), F.col("r").alias("rb"), F.col("level").alias("lb"))
    first = (F.col("cell.x") == F.floor(F.greatest(F.col("ra")[0], F.col("rb")[0]) / step)) & (
        F.col("cell.y") == F.floor(F.greatest(F.col("ra")[1], F.col("rb")[1]) / step)
    )
    touch = (
        (F.col("ra")[0] <= F.col("rb")[2]) & (F.col("rb")[0] <= F.col("ra")[2]) & (F.col("ra")[1] <= F.col("rb")[3]) & (F.col("rb")[1] <= F.col("ra")[3])
    )
    once = (F.col("lb") < F.col("at")) | (F.col("a") < F.col("b"))  # of one level both look at each other
    met = home.join(seen, [*by, "at", "cell"]).where((F.col("a") != F.col("b")) & once & touch & first)
    return met.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
