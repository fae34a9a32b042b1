"""Text of whole pages folded where it is read: the same as by rows, and no run or glyph moves."""

import random

import pytest

from pagequarry.kernels import content as machine
from pagequarry.operators import boxes, layout, resources, tables, text
from pagequarry.sources import sinks, writer

FONT = b"/Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> " \
    b"/F2 << /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /Encoding << /Differences [97 /fi /nothing] >> >> >> >>"
BITS = [
    b"(ab c) Tj 20 0 Td", b"(x?:) Tj 31.5 0 Td", b"() Tj 1 0 Td", b"(a b ) Tj 14 -12 Td", b"(  ) Tj 9 0 Td", b"(" + b"long word " * 9 + b") Tj 30 0 Td", b"3 0 Td", b"-60.5 -12 Td", b"T*", b"12 TL", b"/F1 9 Tf",
    b"/F2 7 Tf", b"1 0 0 1 5 600 Tm", b"0 1 -1 0 5 6 Tm", b"2 0 0 2 1 1 cm", b"q", b"Q", b"1 Tc", b"50 Tz", b"2 Ts", b"3 Tw", b"0 Tc", b"[(a) -300 (b c)] TJ", b"(k) '", b"%c\n", b"(a\\)b) Tj", b"<41> Tj", b"1 0 0 -1 0 9 Tm",
]


def contents(n: int, seed: int) -> list[bytes]:
    rng = random.Random(seed)
    made = [b"BT /F1 10 Tf 36 800 Td " + b" ".join(rng.choice(BITS[:8] if rng.random() < 0.6 else BITS) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return [b"", b"BT /F1 10 Tf () Tj", b"BT /F1 10 Tf (  ) Tj 3 0 Td ( ) Tj 3 0 Td", b"(a) Tj 1 0 Td (b", *made]


def document(pages: list[bytes]) -> bytes:
    tree, root, _ = writer.page_tree(100, [b"/Contents %d 0 R" % (10 + i) for i in range(len(pages))], FONT)
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root} | {10 + i: writer.stream(c) for i, c in enumerate(pages)}
    return writer.revision(b"", bodies | tree, b"/Root 1 0 R")


@pytest.fixture(scope="module")
def read(spark, corpus):
    """Rows of the machine, and what a fold makes of the same pages."""
    found = corpus(document(contents(40, 1)), document(contents(3, 2)), document([b""]))
    page = resources.with_res(found.pages).withColumn("matrix", tables.page_matrix("default"))
    rows = tables.folding(found.live, page, resources.dictionaries(found.live, found.shared)).cache()
    return tables.interpreted(rows).cache(), lambda fold, schema: tables.placed(rows, fold, schema)


def same(folded, expected) -> None:
    columns = expected.columns
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (folded, expected))
    assert b and a == b
    above = folded._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Window" not in above and "Generate" not in above


def test_runs_and_glyphs_are_placed_as_by_rows():
    for data in contents(300, 3):
        rows = [r for r in machine.Machine().run(data) if r["kind"] == "text"]
        held = machine.Placed()
        rest = list(machine.Machine(kinds=frozenset(("text",)), placed=held).run(data))
        held.end_page(1, 0)
        held.finish()
        assert all(r["kind"] == "error" for r in rest)
        assert [(r["seq"], r["name"], r["size"], r["x"], r["y"], "".join(r["glyphs"][0])) for r in rows] == list(zip(held.seq, held.names, held.size, held.x, held.y, held.said(), strict=True))
        for k, column in enumerate((held.texts, held.xs, held.ys, held.dxs, held.dys)):
            assert [v for r in rows for v in r["glyphs"][k]] == list(column)


def test_pages_texts_are_folded_without_moving_runs(read):
    runs, placed = read
    same(placed(text.page_texts, text.PAGE_TEXT), text.untagged_text(runs))


def test_texts_counted_by_words_come_from_folded_pages(read):
    runs, placed = read
    same(placed(text.page_texts, text.PAGE_TEXT).groupBy("doc_id").agg({"text": "max"}), text.untagged_text(runs).groupBy("doc_id").agg({"text": "max"}))


def test_glyphs_are_counted_without_becoming_rows(read):
    runs, placed = read
    same(placed(sinks.page_counts, sinks.PAGE_COUNT), runs.where("kind = 'text'").groupBy("doc_id", "page_index").agg({"*": "count"}).withColumnRenamed("count(1)", "n_runs"))
    same(placed(sinks.page_counts, sinks.PAGE_COUNT).where("n_glyphs > 0").drop("n_runs"), sinks.glyphs(runs).groupBy("doc_id", "page_index").count().withColumnRenamed("count", "n_glyphs"))


def test_glyph_rows_come_numbered_from_their_page(read):
    runs, placed = read
    same(placed(sinks.glyph_columns, sinks.GLYPHS), sinks.glyphs(runs))


def test_words_are_found_without_moving_glyphs(read):
    runs, placed = read
    same(placed(layout.word_columns, layout.WORDS), layout.words(layout.glyph_boxes(runs)))


def test_lines_are_found_without_moving_glyphs(read):
    runs, placed = read
    same(placed(layout.line_columns, layout.LINES), boxes.line_rows(layout.glyph_boxes(runs)))
