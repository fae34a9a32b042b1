"""The corpus pipeline: stages that each call one operator of the ``llm`` subpackage.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm import mixing, near_dedup, pii, quality_rules, sentencepiece_dropout


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.apply_rules(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source replicated to an equal share of a mixture of the same size, in shuffled order."""
    targets = docs.select("source").distinct().withColumn("weight", F.lit(1.0))
    return mixing.mix(docs, targets).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of the whole text; copies of a document are numbered and cut each on its own."""
    alike = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy("doc_id")
    copies = docs.select("doc_id", "source", "text", F.row_number().over(alike).alias("copy"))
    return sentencepiece_dropout.encode(copies, by=("doc_id", "copy")).select("doc_id", "source", "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", redact_private),
    ("source_mixture", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Token segmentation is not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
