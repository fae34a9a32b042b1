import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagequarry import plans
from pagequarry.functions import geometry, labels
from pagequarry.operators import ranges, sequences, tables, text, trees
from pagequarry.sources import render

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import os

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.12g}") + 0.0
    return v


#: Document queries that the suite compares; the others differ in what they read, not in how.
DOCUMENT_QUERIES = (
    "pdf_text_round_trip", "pdf_pages", "pdf_live_objects", "pdf_newest_entries", "pdf_form_fields", "pdf_structure_text", "pdf_flattened_forms", "pdf_graphics_state", "pdf_selections",
    "pdf_password_errors", "pdf_first_pages", "pdf_first_words", "pdf_form_views", "pdf_restricted_operators", "pdf_damaged_pages", "pdf_annotation_links", "pdf_unreachable_objects",
    "pdf_tree_problems", "pdf_tree_lookups", "pdf_composite_text", "pdf_type3_text", "pdf_packets", "pdf_columns", "pdf_strong_keys", "pdf_source_objects", "pdf_sql_tokens",
    "pdf_effects", "pdf_field_selections", "pdf_element_boxes", "pdf_logical_text",
)


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if not n.startswith("pdf_") or n in DOCUMENT_QUERIES])
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    both = [sorted(repr(tuple(map(plain, r))) for r in x[columns].astype(object).itertuples(index=False)) for x in (got, want)]
    assert both[0] == both[1]


def test_page_labels(spark):
    def label(style, start, offset):
        return spark.range(1).select(labels.page_label(F.lit(style), F.lit(None).cast("string"), F.lit(start), F.lit(offset))).first()[0]

    assert [label("r", 1, 3), label("R", 0, 8), label("a", 1, 25), label("A", 1, 26), label("a", 1, 701), label("D", 5, 2), label("x", 1, 1)] == [
        "iv", "IX", "z", "AA", "zz", "7", "",
    ]


def test_touching_rectangles_overlap(spark):
    a, b = (F.array(*[F.lit(float(v)) for v in r]) for r in ((0, 0, 10, 10), (10, 2, 12, 4)))
    row = spark.range(1).select(geometry.h_overlaps(a, b), geometry.h_overlap(a, b), geometry.v_overlap(a, b), geometry.h_distance(a, b)).first()
    assert tuple(row) == (True, 0.0, 4.0, 0.0)


def test_spatial_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    rects = [(1 + i % 2, i, sorted_rect(rng)) for i in range(120)]
    df = spark.createDataFrame(rects, "page int, node int, rect array<double>")
    got = {(r.a, r.b) for r in ranges.spatial_pairs(df, ["page"], "node", "rect").collect()}
    want = {
        (i, j) for p, i, r in rects for q, j, s in rects
        if p == q and i < j and r[0] <= s[2] and s[0] <= r[2] and r[1] <= s[3] and s[1] <= r[3]
    }
    assert got == want


def sorted_rect(rng):
    x, y = rng.uniform(-200, 400), rng.uniform(-200, 400)
    return [x, y, x + rng.uniform(0, 120), y + rng.uniform(0, 120)]


def test_later_runs_replace_earlier_ones(spark):
    rows = [(1, i, m) for i, m in enumerate([3, 3, None, 5, 3, 3, 3, 7])]
    df = spark.createDataFrame(rows, "doc int, seq int, mcid int")
    got = {r.mcid: (r.place, r.begin, r.n) for r in sequences.content_sections(df, ["doc"], ["seq"], "mcid").collect()}
    assert got == {3: (1, 5, 3), 5: (3, 4, 1), 7: (5, 8, 1)}


def test_tree_walk_inherits_and_skips_cycles(spark):
    rows = [(1, "a", None, 0, "x", "red"), (1, "b", "a", 1, "y", None), (1, "c", "a", 0, "z", "blue"), (1, "d", "b", 0, "w", None), (1, "e", "f", 0, "q", None), (1, "f", "e", 0, "q", None)]
    df = spark.createDataFrame(rows, "doc_id int, node string, parent string, ord long, name string, kind string")
    got = {r.node: (r.depth, r.path, r.kind) for r in trees.walk(df, ["doc_id"], inherit=("kind",)).collect()}
    assert got == {"a": (0, "x", "red"), "b": (1, "x.y", "red"), "c": (1, "x.z", "blue"), "d": (2, "x.y.w", "red")}


def test_text_lines_and_gaps(spark):
    def glyphs(s, x, y):
        return [(c, x + 5.0 * i, y, 5.0, 0.0) for i, c in enumerate(s)]

    rows = [("ab", 0.0, 100.0), ("cd", 10.4, 100.0), ("ef", 25.0, 100.0), (" gh", 50.0, 100.0), ("low", 0.0, 80.0), ("up", 0.0, 90.0)]
    data = [(1, 0, i, "text", x, y, glyphs(s, x, y)) for i, (s, x, y) in enumerate(rows)]
    df = spark.createDataFrame(data, f"doc_id int, page_index int, seq int, kind string, x double, y double, glyphs array<{tables.GLYPH}>")
    # a rise begins no line; a gap of at most half a unit is no space; a text that begins with a space gets another
    assert text.untagged_text(df).first().text == "abcd ef  gh\nlowup"


def test_damaged_documents_give_rows(spark):
    good = render.document([["one", "two"], []], {"Title": "t"})
    rows = [(1, good), (2, b""), (3, None), (4, b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 9 0 R >> endobj"), (5, good[:-200])]
    df = spark.createDataFrame(rows, "doc_id long, content binary")
    parts = tables.parts(df)
    objs = tables.objects(parts)
    assert {r.doc_id for r in objs.collect()} == {1, 4, 5}
    assert {r["kind"] for r in tables.tokens(df).where("doc_id = 1").select("kind").distinct().collect()} >= {"number", "name", "keyword"}
    state = {r.doc_id: r for r in tables.states(parts).collect()}
    assert {i: r.recovered for i, r in state.items()} == {1: False, 2: True, 3: True, 4: True, 5: True} and "no header" in state[2].recovery_error
    live = tables.current(objs)
    pages = tables.pages(live, tables.catalog(live, tables.states(parts)))
    assert [(r.doc_id, r.page_index) for r in pages.orderBy("doc_id", "page_index").collect()] == [(1, 0), (1, 1), (5, 0), (5, 1)]  # 5 has no trailer left: its page dictionaries


def test_object_streams(spark):
    body = b"10 0 11 3 42 << /A /B >>"
    data = b"7 0 obj << /Type /ObjStm /N 2 /First 10 /Length %d >> stream\n%s\nendstream endobj" % (len(body), body)
    bad = b"8 0 obj << /Type /ObjStm /N 2 /Length 3 >> stream\nabc\nendstream endobj"
    df = spark.createDataFrame([(1, data), (2, bad)], "doc_id long, content binary")
    got = [(r.obj, r.container, r.value, r.error is None) for r in tables.objects(df).orderBy("doc_id", "seq").collect()]
    assert got[1:3] == [(10, 7, "42", True), (11, 7, '{"A": "/B"}', True)] and got[4][3] is False


def test_tagged_sections(corpus):
    content = (
        b"BT /F1 10 Tf 0 100 Td /P << /MCID 0 >> BDC (One ) Tj (two) Tj EMC /Artifact BMC (page 7) Tj EMC "
        b"/Span << /MCID 1 /ActualText (three) >> BDC (xxx) Tj EMC 0 -12 Td /P << /MCID 2 >> BDC (soft\xadly) Tj EMC "
        b"/ReversedChars << /MCID 3 >> BDC (cba) Tj EMC ET"
    )
    assert text.tagged_text(corpus(render.document([content], {})).runs()).first().text == "One twothree\nsoftlyabc"
