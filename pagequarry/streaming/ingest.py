"""Continuous ingestion: files that arrive in a folder become rows of the objects relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators import tables


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a streaming corpus: doc_id hashed from the path, path, arrival time and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("arrived"), "content")


def ingest_objects(corpus: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and append its objects to ``out``; stops when nothing is left."""
    return (
        tables.objects(corpus)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def arrivals(corpus: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by arrival window; rows later than the watermark are not counted."""
    return (
        corpus.withWatermark("arrived", late)
        .groupBy(F.window("arrived", window).alias("window"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
        .select(F.col("window.start").alias("start"), "files", "bytes")
    )
