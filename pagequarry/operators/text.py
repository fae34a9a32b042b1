"""Text assembly from placed runs: lines by falling baselines, spaces by gaps."""

from __future__ import annotations

import textwrap

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagequarry.kernels.content import Placed
from pagequarry.operators import sequences
from pagequarry.operators.navigation import text_value

#: A horizontal gap above this many units is a space.
GAP = 0.5
WRAP = 70


def page_order(*order: str):
    """Window over the rows of each page."""
    return Window.partitionBy("doc_id", "page_index").orderBy(*order)


def run_text(glyphs: Column) -> Column:
    """Text of one run; a gap between its glyphs is a space unless one precedes it."""

    def one(g: Column, i: Column) -> Column:
        before = F.get(glyphs, i - 1)
        end = before["x"] + before["dx"]
        gap = (i > 0) & (end != 0) & (g["x"] - end > GAP) & (before["text"] != " ")
        return F.concat(F.when(gap, " ").otherwise(""), g["text"])

    return F.array_join(F.transform(glyphs, one), "")


def untagged_text(runs: DataFrame, down: str = "page") -> DataFrame:
    """doc_id, page_index and the page's text.

    ``runs`` are rows of kind text. A run whose origin lies below the last
    one's (above, in screen space) begins a line; within a line a gap of more
    than ``GAP`` to the last run's end is a space, unless a space is there.
    """
    glyphs = F.col("glyphs")
    last = F.element_at(glyphs, -1)
    n = F.size(glyphs)
    placed = runs.where("kind = 'text'").select(
        "doc_id", "page_index", "seq", "x", "y", n.alias("n"), run_text(glyphs).alias("text"),
        F.when(n > 0, last["x"] + last["dx"]).otherwise(F.col("x")).alias("end"),
    )
    order = Window.partitionBy("doc_id", "page_index").orderBy("seq")

    def prev(c: str) -> Column:
        return F.lag(c).over(order)

    fall = F.col("y") - F.col("py")
    fall = -fall if down == "screen" else fall
    seen = placed.select("*", prev("y").alias("py"), prev("end").alias("pend"), prev("text").alias("ptext"), prev("n").alias("pn"))
    gap = F.col("x") - F.col("pend")
    wide = (gap > GAP) | ((F.col("n") == 1) & (F.col("pn") > 1) & (gap > GAP - 1e-9))
    first = F.col("py").isNull() | (fall < 0)
    marked = seen.select(
        "doc_id", "page_index", "seq",
        F.sum(F.when(first, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("line"),
        F.concat(F.when(~first & wide & ~F.col("ptext").endswith(" "), " ").otherwise(""), "text").alias("piece"),
        first.alias("first"),
    )
    pieces = F.sort_array(F.collect_list(F.struct("seq", "line", F.concat(F.when(F.col("first") & (F.col("line") > 1), "\n").otherwise(""), "piece").alias("piece"))))
    return marked.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))


#: Columns of :func:`page_texts`.
PAGE_TEXT = "doc_id long, page_index int, text string"


def page_texts(held: Placed, down: str = "page") -> list:
    """What :func:`untagged_text` gives, of pages whose runs are together: a fold for :func:`pagequarry.operators.tables.placed`."""
    ends, x, y, xs, said = held.ends, held.x, held.y, held.xs, held.said()
    n, stop = np.diff(ends, prepend=0), xs + held.dxs
    if len(xs) > 1:  # gaps within runs
        inner = np.ones(len(xs), bool)
        inner[(ends - n)[n > 0]] = False
        wide = inner[1:] & (stop[:-1] != 0) & (xs[1:] - stop[:-1] > GAP)
        spaced = {i: None for i in (np.nonzero(wide)[0] + 1).tolist() if held.texts[i - 1] != " "}
        for run in dict.fromkeys(np.searchsorted(ends, list(spaced), side="right").tolist()):
            own = range(ends[run] - n[run], ends[run])
            said[run] = "".join([" " + held.texts[i] if i in spaced else held.texts[i] for i in own])
    end = x.copy()
    end[n > 0] = stop[ends[n > 0] - 1]
    begins = np.zeros(len(x), bool)
    begins[[0, *held.page_ends[:-1]]] = True
    fall, gap, pn = np.diff(y, prepend=0.0), np.append(0.0, x[1:] - end[:-1]), np.append(0, n[:-1])
    falls = (-fall if down == "screen" else fall) < 0
    wide = (gap > GAP) | ((n == 1) & (pn > 1) & (gap > GAP - 1e-9))
    before = np.where(begins, 0, np.where(falls, 2, wide)).tolist()
    marks = "", " ", "\n"
    pieces = [t if not k or (k == 1 and p.endswith(" ")) else marks[k] + t for k, t, p in zip(before, said, ["", *said[:-1]], strict=True)]
    bounds = zip([0, *held.page_ends[:-1]], held.page_ends, strict=True)
    return [[p[0] for p in held.pages], [p[1] for p in held.pages], ["".join(pieces[a:b]) for a, b in bounds]]


def crosses(runs: DataFrame, box: list[float]) -> DataFrame:
    """Text runs whose baseline crosses a box: strictly across, touching up and down."""
    last = F.element_at("glyphs", -1)
    end_x = F.coalesce(last["x"] + last["dx"], F.col("x"))
    low, high = F.least("x", end_x), F.greatest(F.col("x"), end_x)
    return runs.where(
        (F.greatest(low, F.lit(box[0])) < F.least(high, F.lit(box[2]))) & (F.greatest("y", F.lit(box[1])) <= F.least("y", F.lit(box[3])))
    )


@F.pandas_udf(StringType())
def wrapped(values: pd.Series) -> pd.Series:
    """Values filled to ``WRAP`` columns."""
    return values.map(lambda v: textwrap.fill(v, WRAP) if v else "")


def reordered(told: DataFrame, ranks: DataFrame) -> DataFrame:
    """Sections of pages in the order of the structure, where every one that is not silent has one content id of its own with a rank."""
    by = ["doc_id", "page_index"]
    met = told.join(ranks, [*by, "mcid"], "left")
    loud = ~F.col("silent")
    page = Window.partitionBy(*by)
    usable = (F.sum(F.when(loud & F.col("rank").isNull(), 1).otherwise(0)).over(page) == 0) & (
        F.size(F.collect_set(F.when(loud, F.col("mcid"))).over(page)) == F.sum(F.when(loud, 1).otherwise(0)).over(page)
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(F.col("usable"), F.col("rank")), "section"))
    return met.withColumn("usable", usable).withColumn("section", place).drop("usable", "rank")


def tagged_text(runs: DataFrame, down: str = "page", ranks: DataFrame | None = None, actual: DataFrame | None = None) -> DataFrame:
    """doc_id, page_index and the text of the page's marked sections, in paint order, or by ``ranks`` in that of the structure.

    ``actual`` (doc_id, page_index, mcid, outer) has the ActualText that the structure gives: it replaces all
    sections of its element and is said once.

    Consecutive runs in one innermost marked section are a section. Sections without
    a mark or marked Artifact are silent but move the line state; ActualText replaces
    a section's text and leaves the line state alone; reversed characters are turned
    round and soft hyphens dropped. A section with another content id than the last
    one that lies below it begins a line, and lines are wrapped.
    """
    by, top = ["doc_id", "page_index"], F.element_at("marked", -1)
    placed = runs.where("kind = 'text' AND size(glyphs) > 0").select(
        *by, "seq", "x", "y", top.alias("top"), F.array_join(F.transform("glyphs", lambda g: g["text"]), "").alias("text")
    )
    order = Window.partitionBy(*by).orderBy("seq")
    seen = placed.withColumn("before", F.lag(F.coalesce("top.id", F.lit(-1))).over(order))
    same = F.col("before") == F.coalesce("top.id", F.lit(-1))
    numbered = sequences.runs(seen, by, ["seq"], ~F.coalesce(same, F.lit(False)), "section")
    spelled = F.when(F.col("top.tag") == "ReversedChars", F.reverse("text")).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", spelled.alias("t")))), lambda p: p["t"]), "")
    sections = numbered.groupBy(*by, "section").agg(F.first("top").alias("top"), F.max_by("y", "seq").alias("y"), joined.alias("text"))
    tag, own_text = F.col("top.tag"), F.col("top.actual")
    silent = tag.isNull() | (tag == "Artifact")
    value = F.when(own_text.isNotNull(), text_value(own_text)).otherwise(F.col("text"))
    told = sections.select(
        *by, "section", "y", F.col("top.mcid").alias("mcid"), silent.alias("silent"), (~silent & own_text.isNull()).alias("advances"),
        F.replace(F.coalesce(value, F.lit("")), F.lit("\u00ad"), F.lit("")).alias("value"),
    )
    if actual is not None:
        first = F.row_number().over(Window.partitionBy(*by, "outer.node").orderBy("section")) == 1
        given = told.join(actual, [*by, "mcid"], "left").withColumn("first", first)
        has = F.col("outer").isNotNull() & ~F.col("silent")
        told = given.withColumn("value", F.when(has & F.col("first"), F.col("outer.text")).when(has, "").otherwise(F.col("value")))
        told = told.withColumn("advances", F.col("advances") & ~has).drop("outer", "first")
    if ranks is not None:
        told = reordered(told, ranks)
    earlier = Window.partitionBy(*by).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last_y = F.last(F.when(F.col("silent") | F.col("advances"), F.col("y")), ignorenulls=True).over(earlier)
    last_id = F.last(F.when(~F.col("silent"), F.struct("mcid")), ignorenulls=True).over(earlier)
    fall = F.col("y") - F.col("last_y")
    begins = F.col("advances") & ~F.col("mcid").eqNullSafe(F.col("last_id.mcid")) & ((-fall if down == "screen" else fall) < 0)
    lined = told.select("*", last_y.alias("last_y"), last_id.alias("last_id"))
    lined = sequences.runs(lined, by, ["section"], F.coalesce(begins, F.lit(False)), "line").where(~F.col("silent"))
    lines = lined.groupBy(*by, "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "value"))), lambda p: p["value"]), "").alias("value")
    )
    filled = lines.select(*by, "line", wrapped("value").alias("value")).where("value <> ''")
    return filled.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda p: p["value"]), "\n").alias("text"))


def extract_text(
    runs: DataFrame, tagged: DataFrame, down: str = "page", ranks: DataFrame | None = None, actual: DataFrame | None = None, box: list[float] | None = None
) -> DataFrame:
    """Tagged text of the documents that ``tagged`` (doc_id) lists, untagged text of the others.

    ``ranks`` and ``actual`` (of :mod:`pagequarry.operators.structure`) give tagged pages the structure's order and
    ActualText; with ``box`` only what crosses it counts.
    """
    own = tagged.select("doc_id").distinct()
    shown = runs if box is None else crosses(runs.where("kind = 'text'"), box)
    read = tagged_text(shown.join(own, "doc_id", "left_semi"), down, ranks, actual)
    return read.unionByName(untagged_text(shown.join(own, "doc_id", "left_anti"), down))
