"""Text boxes, groups, reading order and paragraphs from the lines of each page.

Lines are rows; what hangs together on a page depends on the order in which
lines and boxes are met, so each page's lines are folded in one call (a page is
the unit, however many pages there are).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.operators import layout
from pagequarry.operators.text import page_order

LINE_MARGIN, FLOW, CELL, BATCH_ROWS = 0.5, 0.5, 50, 2000
BOX = "doc_id long, page_index int, line int, box int, place int"


def line_rows(boxes: DataFrame) -> DataFrame:
    """One row per line of :func:`pagequarry.operators.layout.glyph_boxes`: text with spaces at word gaps, and bounds."""
    order = page_order("seq", "glyph_seq")
    seen = layout.lines(boxes).select("*", F.lag("x1").over(order).alias("px1"), F.lag("line").over(order).alias("pline"))
    margin = layout.WORD_MARGIN * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    gap = (F.col("pline") == F.col("line")) & (F.col("px1") < F.col("x0") - margin)
    piece = F.concat(F.when(gap, " ").otherwise(""), "text")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "glyph_seq", piece.alias("t")))), lambda g: g["t"]), "")
    return seen.groupBy("doc_id", "page_index", "line").agg(
        spelled.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def near(a: tuple, b: tuple, d: float) -> bool:
    """Whether line b is as high as a and aligned with it left, right or in the middle, all within ``d``."""
    alike = abs((b[3] - b[1]) - (a[3] - a[1])) <= d
    return alike and (abs(a[0] - b[0]) <= d or abs(a[2] - b[2]) <= d or abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) <= d)


def neighbours(rects: list[tuple], margin: float) -> list[list[int]]:
    """For each line the lines within ``margin`` heights above or below that are near it, in their order."""
    grid: dict[tuple[int, int], list[int]] = {}

    def cells(r: tuple):
        return [(x, y) for x in range(int(r[0] // CELL), int(r[2] // CELL) + 1) for y in range(int(r[1] // CELL), int(r[3] // CELL) + 1)]

    wide = {i for i, r in enumerate(rects) if (r[2] - r[0]) * (r[3] - r[1]) > 4096 * CELL * CELL}  # these would fill the grid
    for i, r in enumerate(rects):
        if i not in wide:
            for cell in cells(r):
                grid.setdefault(cell, []).append(i)
    out = []
    for i, r in enumerate(rects):
        d = margin * (r[3] - r[1])
        reach = (r[0], r[1] - d, r[2], r[3] + d)
        found = range(len(rects)) if i in wide else sorted({j for cell in cells(reach) for j in grid.get(cell, ())} | wide)
        meets = [j for j in found if rects[j][2] > reach[0] and reach[2] > rects[j][0] and rects[j][3] > reach[1] and reach[3] > rects[j][1]]
        out.append([j for j in meets if near(r, rects[j], d)])
    return out


def gathered(rects: list[tuple], margin: float) -> list[list[int]]:
    """Boxes of lines: each line takes its neighbours and the boxes that hold them; boxes in order of their first line."""
    held: dict[int, int] = {}
    boxes: dict[int, list[int]] = {}
    for i, found in enumerate(neighbours(rects, margin)):
        members = [i]
        for j in found:
            members.append(j)
            if j in held:
                members += boxes.pop(held[j], [])
        boxes[i] = list(dict.fromkeys(members))
        for j in boxes[i]:
            held[j] = i
    order, out = set(), []
    for i in range(len(rects)):
        if held[i] in boxes and held[i] not in order:
            order.add(held[i])
            out.append(sorted(boxes[held[i]], key=lambda j: -rects[j][3]))
    return out


def bounds(rects: list[tuple]) -> tuple:
    return min(r[0] for r in rects), min(r[1] for r in rects), max(r[2] for r in rects), max(r[3] for r in rects)


def score(r: tuple, flow: float) -> float:
    """Smaller is read earlier: to the left, and above."""
    return (1 - flow) * r[0] - (1 + flow) * (r[1] + r[3])


def reading_order(rects: list[tuple], flow: float = FLOW) -> list[int]:
    """Boxes in reading order: pairs that waste least area merge first, unless another box lies between; children by score."""

    def area(r: tuple) -> float:
        return (r[2] - r[0]) * (r[3] - r[1])

    def pair(i: int, j: int) -> tuple:
        waste = area(bounds([nodes[i][0], nodes[j][0]])) - area(nodes[i][0]) - area(nodes[j][0])
        return False, round(waste, 6), nodes[i][2], nodes[j][2], i, j

    def between(i: int, j: int) -> bool:
        x0, y0, x1, y1 = bounds([nodes[i][0], nodes[j][0]])
        return any(k not in (i, j) and r[2] > x0 and x1 > r[0] and r[3] > y0 and y1 > r[1] for k in active for r in (nodes[k][0],))

    nodes: list[tuple[tuple, list[int], int]] = [(r, [i], len(rects) + i) for i, r in enumerate(rects)]
    active = set(range(len(nodes)))
    heap = [pair(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes))]
    heapq.heapify(heap)
    merged = 0
    while len(active) > 1:
        blocked, waste, a, b, i, j = heapq.heappop(heap)
        if i not in active or j not in active:
            continue
        if not blocked and between(i, j):
            heapq.heappush(heap, (True, waste, a, b, i, j))
            continue
        first, second = sorted((i, j), key=lambda k: score(nodes[k][0], flow))
        nodes.append((bounds([nodes[i][0], nodes[j][0]]), nodes[first][1] + nodes[second][1], merged))
        merged += 1
        active -= {i, j}
        new = len(nodes) - 1
        for k in sorted(active):
            heapq.heappush(heap, pair(new, k))
        active.add(new)
    return nodes[active.pop()][1] if active else []


def positional_order(rects: list[tuple]) -> list[int]:
    """Boxes from top to bottom, those of equal height from left to right."""
    return sorted(range(len(rects)), key=lambda i: (-rects[i][3], rects[i][0]))


def by_page(lines: DataFrame, fold: Callable[[list[tuple], list[int]], list[tuple]]) -> DataFrame:
    """Rows (line, box, place) that ``fold`` makes of each page's bounds and line numbers, in order of the lines.

    Pages are small and many: a task goes through its sorted rows and folds a page when the next begins. The number of
    partitions is stated, so that few bytes do not end in few tasks.
    """
    arrow = to_arrow_schema(StructType.fromDDL(BOX))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rects, numbers, out = None, [], [], []

        def rows() -> list[tuple]:
            return [(*page, *row) for row in fold(rects, numbers)] if page else []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for held in batches:
            for doc_id, index, line, *rect in zip(*[c.to_pylist() for c in held.columns], strict=True):
                if (doc_id, index) != page:
                    out += rows()
                    page, rects, numbers = (doc_id, index), [], []
                    if len(out) >= BATCH_ROWS:
                        yield batch()
                        out = []
                rects.append(tuple(rect))
                numbers.append(line)
        out += rows()
        if out:
            yield batch()

    slots = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = lines.select("doc_id", "page_index", "line", "x0", "y0", "x1", "y1").repartition(slots, "doc_id", "page_index")
    return thin.sortWithinPartitions("doc_id", "page_index", "line").mapInArrow(of, BOX)


def box_lines(lines: DataFrame, margin: float = LINE_MARGIN, flow: float | None = FLOW) -> DataFrame:
    """doc_id, page_index, line, its box (numbered in reading order from 0) and its place in the box.

    Lines of white space alone form no box. Without ``flow`` boxes are numbered by position.
    """

    def fold(rects: list[tuple], numbers: list[int]) -> list[tuple]:
        boxes = gathered(rects, margin)
        frames = [bounds([rects[j] for j in box]) for box in boxes]
        ordered = positional_order(frames) if flow is None else reading_order(frames, flow)
        return [(numbers[j], n, place) for n, k in enumerate(ordered) for place, j in enumerate(boxes[k])]

    return by_page(lines.where(F.col("text").rlike(r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]")), fold)


def text_boxes(lines: DataFrame, margin: float = LINE_MARGIN, flow: float | None = FLOW) -> DataFrame:
    """One row per box: lines, text (a line each) and bounds."""
    placed = lines.join(box_lines(lines, margin, flow), ["doc_id", "page_index", "line"])
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    return placed.groupBy("doc_id", "page_index", "box").agg(
        F.count(F.lit(1)).alias("n_lines"), listed.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def paragraphs(lines: DataFrame, margin: float = LINE_MARGIN) -> DataFrame:
    """doc_id, page_index, line and paragraph: lines that hang together through near ones, numbered by their first line."""

    def fold(rects: list[tuple], numbers: list[int]) -> list[tuple]:
        label = list(range(len(rects)))

        def find(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for i, found in enumerate(neighbours(rects, margin)):
            for j in found:
                a, b = sorted((find(i), find(j)))
                label[b] = a
        roots = [find(i) for i in range(len(rects))]
        number = {r: n for n, r in enumerate(dict.fromkeys(roots))}
        return [(line, number[r], 0) for line, r in zip(numbers, roots, strict=True)]

    return by_page(lines, fold).select("doc_id", "page_index", "line", F.col("box").alias("paragraph"))


def items(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """The page's layout: boxes in reading order, then images, forms and the parts of paths in paint order."""
    first = boxes.select("doc_id", "page_index", F.lit("box").alias("kind"), F.col("box").alias("ord"), F.lit(0).alias("part"), F.array("x0", "y0", "x1", "y1").alias("bbox"), "text")
    others = runs.where("kind IN ('image', 'xobject')").select(
        "doc_id", "page_index", "kind", F.col("seq").alias("ord"), F.lit(0).alias("part"), "bbox", F.lit(None).cast("string").alias("text")
    )
    shapes = sub_paths(runs).select("doc_id", "page_index", F.lit("path").alias("kind"), F.col("seq").alias("ord"), "part", "bbox", F.lit(None).cast("string").alias("text"))
    rank = F.struct(F.when(F.col("kind") == "box", 0).otherwise(1), "ord", "part")
    return first.union(others).union(shapes).withColumn("item", F.row_number().over(page_order(rank)) - 1).drop("ord", "part")


def sub_paths(runs: DataFrame) -> DataFrame:
    """Each path split where a point is moved to: doc_id, page_index, seq, part, segments, bbox (as written)."""
    each = runs.where("kind = 'path'").select("doc_id", "page_index", "seq", F.posexplode("segments").alias("i", "s"))
    part = F.sum(F.when(F.col("s.op") == "m", 1).otherwise(0)).over(page_order("seq", "i").rowsBetween(Window.unboundedPreceding, 0))
    numbered = each.withColumn("_n", part)
    points = F.flatten(F.collect_list("s.points"))
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    whole = numbered.groupBy("doc_id", "page_index", "seq", "_n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("segments"), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("bbox")
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "page_index", "seq").orderBy("_n")) - 1
    return whole.withColumn("part", place).drop("_n")
