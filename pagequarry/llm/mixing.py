"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the wanted number of documents, divided
by its own number of documents. Each document inverts the Poisson distribution
of its source's rate at a uniform number hashed from seed and doc_id, is
exploded by that count, and every copy gets a hashed key by which the output is
dealt and sorted: a reproducible global shuffle.

The inversion adds up ``MAX_TERMS`` terms of the distribution; rates above
``MAX_RATE`` (a setting no mixture should need) are split into
equal parts below it, one hashed number each, and the parts' counts added, so no
rate is cut.

Defined results: a null source is a source of its own; a source missing from
the targets has weight 0 and leaves; a null doc_id hashes as the empty
string; repeated rows get equal counts; texts of any length move as they are;
extra columns are kept, and where one is named ``copy`` or ``shuffle_key`` the
added column of that name gets underscores appended; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.store import free_name, written

MAX_TERMS = 64
MAX_RATE = 16.0
#: Sources whose rates (a name and a number each) may be broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(rate: Column, u: Column) -> Column:
    """Smallest k whose cumulative probability exceeds ``u``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_TERMS)),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k")),
        lambda acc, i: F.struct(
            (acc["p"] * rate / i).alias("p"),
            (acc["cdf"] + acc["p"] * rate / i).alias("cdf"),
            (acc["k"] + F.when(u >= acc["cdf"], 1).otherwise(0)).alias("k"),
        ),
        lambda acc: acc["k"],
    )


def rates(docs: DataFrame, targets: DataFrame, size_factor: float = 1.0) -> DataFrame:
    """source and rate: mean copies of a document for the mixture to have ``size_factor`` times the documents.

    ``targets`` has source and weight (any non-negative scale); only sources that
    occur share the mixture.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    held = counts.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source")), "left")
    held = held.select(F.col("own").alias("source"), "n", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    total = held.agg(F.sum("n").alias("docs"), F.sum("weight").alias("weights"))
    return held.join(F.broadcast(total)).select(  # one row
        "source", F.when(F.col("weights") > 0, size_factor * F.col("docs") * F.col("weight") / F.col("weights") / F.col("n")).otherwise(F.lit(0.0)).alias("rate")
    )


def with_rates(rows: DataFrame, rate: DataFrame) -> DataFrame:
    """``rows`` (with a struct ``row``) and the rate of their source.

    Up to ``BROADCAST_SOURCES`` sources the rates are broadcast and no document
    moves; beyond it both sides meet by source and salt, so a hot source spreads
    over ``SALTS`` tasks.
    """
    held = written(rate.select(F.col("source").alias("own"), "rate"), "mix-rates")
    same = F.col("row.source").eqNullSafe(F.col("own"))
    if held.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(held), same)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
    spread = held.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("salt") == F.col("salt_of")))


def copies(doc_id: Column, rate: Column, seed: str) -> Column:
    """Number of copies of a document."""
    parts = F.greatest(F.lit(1), F.ceil(rate / MAX_RATE).cast("int"))
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda acc, i: acc + poisson(rate / parts, uniform(F.lit(seed), name, i.cast("string"))),
    )


def mix(docs: DataFrame, targets: DataFrame, size_factor: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` replicated and shuffled, with columns ``copy`` (from 1) and ``shuffle_key``; :func:`free_name` says what they are called."""
    rate = rates(docs, targets, size_factor)
    joined = with_rates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), rate)
    doc_id = F.col("row.doc_id")
    counted = joined.select("row", copies(doc_id, F.col("rate"), seed).alias("k")).where("k > 0")
    exploded = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(doc_id.cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    keyed = exploded.withColumn("shuffle_key", key)
    added = [F.col(c).alias(free_name(c, docs.columns)) for c in ("copy", "shuffle_key")]
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*[F.col("row")[c].alias(c) for c in docs.columns], *added)
