"""Layout of placed glyphs as window operators: words, lines and paragraphs of each page."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.kernels.content import Placed, spelled
from pagequarry.operators import sequences

WORD_MARGIN = 0.1
LINE_OVERLAP = 0.5
CHAR_MARGIN = 2.0


def glyph_boxes(runs: DataFrame) -> DataFrame:
    """One row per glyph with its box: the advance wide, one em of the run high."""
    each = runs.where("kind = 'text'").select("doc_id", "page_index", "seq", "size", F.posexplode("glyphs").alias("glyph_seq", "g"))
    x0, x1 = F.least(F.col("g.x"), F.col("g.x") + F.col("g.dx")), F.greatest(F.col("g.x"), F.col("g.x") + F.col("g.dx"))
    return each.select(
        "doc_id", "page_index", "seq", "glyph_seq", F.col("g.text").alias("text"), x0.alias("x0"), F.col("g.y").alias("y0"), x1.alias("x1"), (F.col("g.y") + F.col("size")).alias("y1")
    )


def _before(order, name: str) -> Column:
    return F.lag(name).over(order)


def lines(boxes: DataFrame) -> DataFrame:
    """Boxes with the ``line`` they lie on: a new one begins where a glyph overlaps the last one too little in height or lies too far from it."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("seq", "glyph_seq")
    seen = boxes.select("*", *[_before(order, c).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    pheight, pwidth = F.col("py1") - F.col("py0"), F.col("px1") - F.col("px0")
    meets = (F.col("y0") <= F.col("py1")) & (F.col("py0") <= F.col("y1"))
    overlap = F.when(meets, F.least(F.abs(F.col("y0") - F.col("py1")), F.abs(F.col("y1") - F.col("py0")))).otherwise(0.0)
    apart = F.when((F.col("x0") <= F.col("px1")) & (F.col("px0") <= F.col("x1")), 0.0).otherwise(
        F.least(F.abs(F.col("x0") - F.col("px1")), F.abs(F.col("x1") - F.col("px0")))
    )
    aligned = meets & (F.least(height, pheight) * LINE_OVERLAP < overlap) & (apart < F.greatest(width, pwidth) * CHAR_MARGIN)
    numbered = sequences.runs(seen, ["doc_id", "page_index"], ["seq", "glyph_seq"], ~F.coalesce(aligned, F.lit(False)), "line")
    return numbered.drop("px0", "py0", "px1", "py1")


def words(boxes: DataFrame) -> DataFrame:
    """Words of each page: text, box, line and place; they end at white space, at a wide gap and with the line."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("seq", "glyph_seq")
    seen = lines(boxes).select("*", *[_before(order, c).alias(f"p{c}") for c in ("x1", "line", "text")])
    margin = WORD_MARGIN * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    gap = F.col("px1") < F.col("x0") - margin
    begins = F.col("pline").isNull() | (F.col("pline") != F.col("line")) | gap | (F.trim("ptext") == "")
    numbered = sequences.runs(seen, ["doc_id", "page_index"], ["seq", "glyph_seq"], begins, "word").where(F.trim("text") != "")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "glyph_seq", "text"))), lambda g: g["text"]), "")
    whole = numbered.groupBy("doc_id", "page_index", "line", "word").agg(
        spelled.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("word"))
    return whole.withColumn("word", place)


class Lined:
    """Glyphs of whole pages with their boxes, where lines begin and where a gap precedes a glyph of the same line, as :func:`lines` and :func:`words` find them."""

    def __init__(self, held: Placed) -> None:
        ends = np.append(0, held.ends)
        page_ends = ends[held.page_ends]
        self.pages, self.texts = held.pages, held.texts
        self.page = np.repeat(np.arange(len(page_ends)), np.diff(page_ends, prepend=0))
        x, dx, self.y0 = held.xs, held.dxs, held.ys
        self.x0, self.x1, self.y1 = np.minimum(x, x + dx), np.maximum(x, x + dx), self.y0 + np.repeat(held.size, np.diff(ends))
        self.first = np.diff(self.page, prepend=-1) != 0
        x0, y0, x1, y1 = self.x0[1:], self.y0[1:], self.x1[1:], self.y1[1:]
        px0, py0, px1, py1 = self.x0[:-1], self.y0[:-1], self.x1[:-1], self.y1[:-1]
        height, width, pheight, pwidth = y1 - y0, x1 - x0, py1 - py0, px1 - px0
        meets = (y0 <= py1) & (py0 <= y1)
        overlap = np.where(meets, np.minimum(np.abs(y0 - py1), np.abs(y1 - py0)), 0.0)
        apart = np.where((x0 <= px1) & (px0 <= x1), 0.0, np.minimum(np.abs(x0 - px1), np.abs(x1 - px0)))
        aligned = meets & (np.minimum(height, pheight) * LINE_OVERLAP < overlap) & (apart < np.maximum(width, pwidth) * CHAR_MARGIN)
        self.begins = self.first.copy()
        self.begins[1:] |= ~aligned
        self.gap = np.zeros(len(self.page), bool)
        self.gap[1:] = px1 < x0 - WORD_MARGIN * np.maximum(width, height)
        at = np.cumsum(self.begins)
        self.line = at - np.maximum.accumulate(np.where(self.first, at, 0)) + 1

    def keys(self, at: np.ndarray) -> list:
        """doc_id and page_index of the glyphs at places."""
        return [np.array([p[k] for p in self.pages], np.int64)[self.page[at]] for k in (0, 1)]

    def bounds(self, begin: np.ndarray, end: np.ndarray) -> list:
        """x0, y0, x1 and y1 of glyphs from ``begin`` up to ``end``, where there are some."""
        at = np.ravel([begin, end], "F")
        at = at[:-1] if len(at) and at[-1] == len(self.page) else at
        return [f.reduceat(v, at)[::2] if len(at) else v[:0] for f, v in ((np.minimum, self.x0), (np.minimum, self.y0), (np.maximum, self.x1), (np.maximum, self.y1))]


#: Columns of :func:`word_columns` and :func:`line_columns`.
WORDS = "doc_id long, page_index int, line long, word int, text string, x0 double, y0 double, x1 double, y1 double"
LINES = "doc_id long, page_index int, line long, text string, x0 double, y0 double, x1 double, y1 double"


def word_columns(held: Placed) -> list:
    """What :func:`words` gives, of pages whose glyphs are together: a fold for :func:`pagequarry.operators.tables.placed`."""
    g = Lined(held)
    blanks = {t for t in set(g.texts) if not t.strip(" ")}
    blank = np.array([t in blanks for t in g.texts], bool)
    starts = g.begins | g.gap
    starts[1:] |= blank[:-1]
    begin = np.nonzero(starts)[0]
    end = np.append(begin[1:], len(g.page)).astype(begin.dtype)
    end = end[: len(begin)] - blank[end[: len(begin)] - 1]  # only a word's last glyph may be blank
    begin, end = begin[end > begin], end[end > begin]
    page = g.page[begin]
    place = np.arange(len(begin))
    return [*g.keys(begin), g.line[begin], place - np.searchsorted(page, page) + 1, spelled(g.texts, begin, end), *g.bounds(begin, end)]


def line_columns(held: Placed) -> list:
    """Lines of pages whose glyphs are together, with spaces at word gaps, and their bounds: a fold for :func:`pagequarry.operators.tables.placed`."""
    g = Lined(held)
    begin = np.nonzero(g.begins)[0]
    end = np.append(begin[1:], len(g.page)).astype(begin.dtype)[: len(begin)]
    at = np.nonzero(g.begins | g.gap)[0]
    pieces = spelled(g.texts, at, np.append(at[1:], len(g.page)).astype(at.dtype)[: len(at)])
    bounds = [*np.searchsorted(at, begin).tolist(), len(at)]
    said = [" ".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [*g.keys(begin), g.line[begin], said, *g.bounds(begin, end)]
