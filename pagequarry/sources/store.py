"""Tables written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

#: Bytes of rows above which a table is never broadcast: files say little, as rows that repeat each other shrink a hundredfold in them,
#: and a broadcast of rows with a few short keys is about ten times its rows.
BROADCAST_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (as in tests) gets a temporary folder; on
    a cluster that would be a folder of one machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _row_bytes(field: StructField) -> Column:
    """About the bytes of a row's column in memory; of text all of them."""
    if isinstance(field.dataType, StringType | BinaryType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    return F.lit(64 if hasattr(field.dataType, "elementType") or hasattr(field.dataType, "fields") else 8)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for joins by sorting alone, whatever its files promise; a union needs this again, as hints of its parts end there."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: its lineage ends there.

    Rows are measured as they are written; a table of more than ``BROADCAST_BYTES`` is joined by sorting.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    each = sum((_row_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    df.observe(seen, F.sum(each).alias("bytes")).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return unbroadcast(back) if (seen.get["bytes"] or 0) > BROADCAST_BYTES else back
