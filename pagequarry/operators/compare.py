"""Two versions of a relation as snapshots, and where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-6
_FRACTIONS = (T.DoubleType, T.FloatType)


def snapshot(rows: DataFrame, section: str, *keys: str) -> DataFrame:
    """section, key and record (JSON) of each row: a canonical form of any relation."""
    key = F.to_json(F.struct(*keys))
    return rows.select(F.lit(section).alias("section"), key.alias("key"), F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("record"))


def same(a: Column, b: Column, kind: T.DataType) -> Column:
    """Equal, or for fractions within ``TOLERANCE``; arrays and structs by their parts; nulls are equal to nulls."""
    if isinstance(kind, _FRACTIONS):
        close = (F.abs(a - b) <= TOLERANCE) | (F.isnan(a) & F.isnan(b)) | (a == b)
        return F.coalesce(close, a.isNull() & b.isNull())
    if isinstance(kind, T.ArrayType):
        paired = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: same(p["a"], p["b"], kind.elementType))
        return F.coalesce((F.size(a) == F.size(b)) & paired, a.isNull() & b.isNull())
    if isinstance(kind, T.StructType):
        parts = F.lit(True)
        for f in kind.fields:
            parts = parts & same(a[f.name], b[f.name], f.dataType)
        return F.coalesce(parts & a.isNotNull() & b.isNotNull(), F.lit(False)) | (a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def differences(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """One row per key and column that differs: keys, column (null where the row itself is missing or added), expected, actual.

    Keys must be unique on either side; both sides meet by them.
    """
    others = [f for f in expected.schema.fields if f.name not in keys]
    left = expected.select(*keys, F.struct(*[f.name for f in others]).alias("_e"))
    right = actual.select(*keys, F.struct(*[f.name for f in others]).alias("_a"))
    met = left.join(right, list(keys), "full")
    shown = [
        F.when(
            ~same(F.col("_e")[f.name], F.col("_a")[f.name], f.dataType),
            F.struct(F.lit(f.name).alias("column"), F.col("_e")[f.name].cast("string").alias("expected"), F.col("_a")[f.name].cast("string").alias("actual")),
        )
        for f in others
    ]
    lone = F.struct(F.lit(None).cast("string").alias("column"), F.to_json("_e").alias("expected"), F.to_json("_a").alias("actual"))
    found = F.when(F.col("_e").isNull() | F.col("_a").isNull(), F.array(lone)).otherwise(F.array_compact(F.array(*shown)))
    return met.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")
