"""Sinks: rows of the relations as JSON lines, in order where the order is the meaning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.kernels.content import Placed


def glyphs(runs: DataFrame) -> DataFrame:
    """One row per shown glyph in paint order: doc_id, page_index, index (from 0 on each page), text, font, size, x, y, dx, dy."""
    shown = runs.where("kind = 'text'").select("doc_id", "page_index", "seq", F.col("name").alias("font"), "size", "glyphs")
    earlier = Window.partitionBy("doc_id", "page_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("first", F.coalesce(F.sum(F.size("glyphs")).over(earlier), F.lit(0)))  # runs are ordered, not their glyphs
    each = placed.select("doc_id", "page_index", "font", "size", "first", F.posexplode("glyphs").alias("nth", "g"))
    return each.select("doc_id", "page_index", (F.col("first") + F.col("nth")).cast("int").alias("index"), F.col("g.text").alias("text"), "font", "size", *[F.col(f"g.{c}").alias(c) for c in ("x", "y", "dx", "dy")])


#: Columns of :func:`glyph_columns`.
GLYPHS = "doc_id long, page_index int, index int, text string, font string, size double, x double, y double, dx double, dy double"


def glyph_columns(held: Placed) -> list:
    """What :func:`glyphs` gives, of pages whose runs are together: a fold for :func:`pagequarry.operators.tables.placed`."""
    ends = np.append(0, held.ends)
    page_ends, of_runs = ends[held.page_ends], np.diff(ends)
    own = np.diff(page_ends, prepend=0)
    ids, numbers = (np.repeat(np.array([p[k] for p in held.pages], np.int64), own) for k in (0, 1))
    index = np.arange(len(held.texts)) - np.repeat(page_ends - own, own)
    named = pa.array(held.names, pa.string()).take(pa.array(np.repeat(np.arange(len(of_runs)), of_runs)))
    return [ids, numbers, index, list(held.texts), named, np.repeat(held.size, of_runs), held.xs, held.ys, held.dxs, held.dys]


#: Columns of :func:`page_counts`.
PAGE_COUNT = "doc_id long, page_index int, n_runs long, n_glyphs long"


def page_counts(held: Placed) -> list:
    """Runs and glyphs of each page that shows text: a fold for :func:`pagequarry.operators.tables.placed`."""
    ends = np.append(0, held.ends)
    return [[p[0] for p in held.pages], [p[1] for p in held.pages], np.diff(held.page_ends, prepend=0), np.diff(ends[held.page_ends], prepend=0)]


def json_lines(rows: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object without its null members."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as text files whose lines, read file after file, are in ``order``: one range shuffle, no single task."""
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    json_lines(kept).write.mode("errorifexists").text(path)


def page_digests(rows: DataFrame) -> DataFrame:
    """doc_id, page_index, number of rows and SHA-256 of the page's JSON lines in order of ``index``."""
    listed = rows.withColumn("value", F.to_json(F.struct(*rows.columns)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("index", "value"))), lambda x: F.sha2(x["value"].cast("binary"), 256))
    return listed.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("digest"))
