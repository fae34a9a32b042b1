"""Marked content as intervals of a page's operations: nesting, parents and ids, without a stack in sight.

Opening and closing operations are +1 and -1. The running sum, lifted by its own
running minimum, is the depth with unmatched closings ignored; on one level
openings and closings alternate, so the next row of the level ends a section and
the last opening of the level above is its parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import sequences
from pagequarry.operators.tables import field
from pagequarry.operators.text import page_order

PAGE = ["doc_id", "page_index"]


def sections(operations: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, page_index, begin and end (operations; end null if nothing closes it), depth, tag, mcid, actual, parent (its begin).

    BDC with neither a dictionary nor a known properties resource opens nothing.
    """
    operands = F.from_json("operands", "array<string>")
    ops = operations.where("operator IN ('BMC', 'BDC', 'EMC')").select(*PAGE, "seq", "operator", F.substring(F.get(operands, F.lit(0)), 2, 2**30).alias("tag"), F.get(operands, F.lit(1)).alias("p"))
    named = entries.where("scope = 0 AND category = 'Properties'").select(*PAGE, F.concat(F.lit("/"), "name").alias("p"), F.col("value").alias("known"))
    met = ops.join(named, [*PAGE, "p"], "left").withColumn("data", F.coalesce("known", "p"))
    valid = met.where((F.col("operator") != "BDC") | F.col("data").startswith("{"))
    running = page_order("seq").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("operator") != "EMC"
    summed = valid.withColumn("opens", opens).withColumn("s", F.sum(F.when(opens, 1).otherwise(-1)).over(running))
    lifted = summed.withColumn("low", F.least(F.lit(0), F.min("s").over(running)))
    unmatched = ~F.col("opens") & (F.col("low") < F.coalesce(F.lag("low").over(page_order("seq")), F.lit(0)))
    level = F.col("s") - F.col("low") + F.when(F.col("opens"), 0).otherwise(1)
    placed = lifted.withColumn("unmatched", unmatched).where("NOT unmatched").withColumn("level", level)
    end = F.lead("seq").over(Window.partitionBy(*PAGE, "level").orderBy("seq"))
    opened = placed.withColumn("end", end).where("opens").select(
        *PAGE, F.col("seq").alias("begin"), "end", F.col("level").cast("int").alias("depth"), "tag", field("data", "MCID").try_cast("int").alias("mcid"), field("data", "ActualText").alias("actual")
    )
    above = opened.select(*PAGE, (F.col("depth") + 1).alias("depth"), "begin", F.col("begin").alias("parent"))
    return sequences.asof(opened, above, [*PAGE, "depth"], "begin", "begin", "parent")


def inside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each of ``rows`` (with seq) in every section that is open there: an interval join within the page, by the innermost first.

    Both sides meet by page and by the section's operations, bucketed, so long sections repeat once a bucket.
    """
    bucket = 256
    last = F.coalesce("end", F.lit(2**31 - 1))
    top = rows.groupBy(*PAGE).agg(F.max("seq").alias("_last"))
    spread = found.join(top, PAGE).withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.greatest("begin", F.least(last, F.col("_last"))) / bucket))))
    keyed = rows.withColumn("_b", F.floor(F.col("seq") / bucket))
    return keyed.join(spread.drop("_last"), [*PAGE, "_b"]).where((F.col("begin") < F.col("seq")) & (F.col("seq") < last)).drop("_b")


def sequence(runs: DataFrame) -> DataFrame:
    """Content sequence of each page: runs of one innermost id; a later run replaces an earlier one and keeps its place."""
    ids = runs.where("kind = 'text'").select(*PAGE, "seq", F.element_at("marked", -1)["mcid"].alias("mcid"))
    return sequences.content_sections(ids, PAGE, ["seq"], "mcid")
