"""Operators over hand-written documents and small rows: resources, forms, marks, boxes, actions, comparison."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.kernels import cmaps, crypt, fonts, glyphnames, images
from pagequarry.operators import boxes, compare, marked, navigation, ranges, resources, sequences, tables
from pagequarry.operators import images as pictures
from pagequarry.sources import sinks, writer
from tests.test_operators import sorted_rect


def page_of(content, extra=b"", *more):
    tree, root, _ = writer.page_tree(10, [b"/Contents 3 0 R " + extra])
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: writer.stream(content)} | dict(more) | tree
    return writer.revision(b"", bodies, b"/Root 1 0 R", "stream")


def test_glyph_names_and_maps():
    assert [glyphnames.glyph_text(n) for n in ("one", "eacute", "quoteright", "Lambda", "afii10023", "f_i.alt", "uni00410042", "nothing")] == ["1", "é", "’", "Λ", "Ё", "fi", "AB", ""]
    m = cmaps.parse(b"begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange begincidrange <20> <7E> 1 <8140> <817E> 633 endcidrange begincidchar <00> 7 endcidchar % <41> 9\n/WMode 1 def")
    assert m.codes(b"A\x81\x40\xff\x00") == [(1, 65), (2, 0x8140), (1, 0)]
    assert [m.cid(*c) for c in m.codes(b"A\x81\x41\x00")] == [34, 634, 7] and m.cid(1, 0x7F) == 0 and m.vertical
    long = cmaps.parse(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfrange <0000> <FFFF> <0000> <0041> <0042> [<0066> <00660069>] endbfrange")
    assert [long.text(2, c) for c in (0x20, 0x41, 0x42, 0xFFFD)] == [" ", "f", "fi", "�"]


def test_standard_widths():
    got = [fonts.standard_width(f, c) for f, c in (("Times-Roman", "A"), ("Times-Bold", "A"), ("Helvetica", "é"), ("Helvetica-Bold", "i"), ("Courier", "i"), ("Times-Italic", "—"))]
    assert got == [722, 722, 556, 278, 600, 889]
    named = fonts.font_of({"BaseFont": "/Times-Roman", "Encoding": {"Differences": [65, "/one", "/eacute"]}}, None)
    assert [(t, w) for t, _, w, _ in named.glyphs(b"AB")] == [("1", 0.5), ("é", 0.444)]
    wide = fonts.font_of({"Subtype": "/Type0", "DescendantFonts": [{"DW": 500, "W": [30, 40, 250]}]}, None, b"begincodespacerange <00> <FF> endcodespacerange begincidrange <00> <FF> 1 endcidrange")
    assert [(c, w) for _, c, w, _ in wide.glyphs(b"\x1d\x50")] == [(30, 0.25), (81, 0.5)]


def test_samples():
    assert images.unpacked(bytes([0b10110000, 0b01000000]), 3, 2, 1, 1).tolist() == [[1, 0, 1], [0, 1, 0]]
    assert images.expanded(images.unpacked(bytes([0x01, 0x20]), 3, 1, 1, 4), b"\1\2\3\4", 2).tolist() == [[1, 2, 3, 4, 0, 0]]


def test_keys_and_passwords():
    spec = {"Filter": "/Standard", "V": 2, "R": 3, "Length": 128, "P": -44, "O": "s:" + (b"o" * 32).hex()}
    key = crypt.file_key(b"open", b"o" * 32, -44, b"id", 16, 3)
    spec["U"] = "s:" + crypt.user_entry(key, b"id", 3).hex()
    assert crypt.unlock(b"open", spec, b"id")["key"] == key and crypt.unlock(b"x", spec, b"id")["error"] == "invalid password"
    assert crypt.unlock(None, spec, b"id")["error"] == "password required" and crypt.unlock(b"", {"V": 9}, b"id")["error"] == "unsupported encryption"
    assert crypt.unlock(b"open", spec | {"O": 5}, b"id")["error"] == "unsupported encryption"


def test_forms_states_and_page_space(corpus):
    form = writer.stream(b"1 0 0 RG 0 0 5 5 re S /Own Do", b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 100 0] /Resources << /XObject << /Own 20 0 R >> >>")
    content = b"/Gs gs q 0.5 g 2 0 0 2 0 0 cm /Fm Do Q 7 w [3 1] 2 d 1 J 0 1 1 0 k 1 1 2 2 re b* /Im Do /Missing gs"
    extra = b"/Rotate 90 /Resources << /XObject << /Fm 20 0 R /Im 21 0 R >> /ExtGState << /Gs << /LW 4 /CA 0.25 >> >> >>"
    picture = writer.stream(b"\0", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray")
    known = corpus(page_of(content, extra, (20, form), (21, picture)))
    opaque, flat = ([r for r in known.runs(flatten).orderBy("seq").collect()] for flatten in (False, True))
    assert [(r.kind, r.name) for r in opaque] == [("xobject", "Fm"), ("path", "b*"), ("image", "Im")]
    assert [r.kind for r in flat] == ["path", "path", "image"] and flat[0].bbox == [200, 0, 210, 10]
    assert flat[0].stroke_color.space == "DeviceRGB" and flat[0].line.width == 4 and flat[0].stroke_alpha == 0.25 and flat[0].fill_color["values"] == [0.5]
    assert flat[1].line.asDict() == {"width": 7, "cap": 1, "join": 0, "miter": 10, "dash": [3, 1], "phase": 2} and flat[1].fill_color["values"] == [0, 1, 1, 0]
    forms = {(r.scope, r.name) for r in resources.forms(known.resources).collect()}
    assert forms == {(0, "Fm"), (20, "Own")} and [r.name for r in resources.images(known.resources).collect()] == ["Im"]
    ops = tables.operations(tables.page_bytes(known.live, known.pages))
    chosen = {(r.operator, r.name): r.known for r in resources.selections(ops, known.resources).collect()}
    assert chosen == {("gs", "Gs"): True, ("gs", "Missing"): False, ("Do", "Fm"): True, ("Do", "Im"): True}
    matrix = known.pages.select(tables.page_matrix("screen").alias("m")).first().m
    assert matrix == [0, 1, 1, 0, 0, 0]


def test_a_stream_that_cannot_be_decoded_gives_an_error_row(corpus):
    bad = page_of(b"x", b"").replace(b"/FlateDecode", b"/NopeDecode", 1)
    broken = writer.revision(b"", {1: b"<< /Type /Catalog /Pages 4 0 R >>", 2: b"<< /Length 1 /Filter 5 0 R >>\nstream\nx\nendstream", 5: b"/NopeDecode", **{k: v for k, v in writer.page_tree(3, [b"/Contents 2 0 R"])[0].items()}}, b"/Root 1 0 R")
    known = corpus(broken, bad)
    rows = tables.page_bytes(known.live, known.pages).where("doc_id = 1").collect()
    assert len(rows) == 1 and "NopeDecode" in rows[0].error
    assert [(r.kind, "NopeDecode" in r.error) for r in known.runs().where("doc_id = 1").collect()] == [("error", True)]


def test_marks_nest_and_unmatched_ends_are_ignored(corpus):
    content = b"EMC /A BMC /B << /MCID 4 >> BDC (x) Tj EMC /C /Known BDC EMC /D /Unknown BDC EMC EMC /E BMC (y) Tj"
    known = corpus(page_of(content, b"/Resources << /Properties << /Known << /MCID 9 >> >> >>"))
    ops = tables.operations(tables.page_bytes(known.live, known.pages)).cache()
    found = marked.sections(ops, known.resources).cache()
    got = {r.tag: (r.begin, r.end, r.depth, r.mcid, r.parent) for r in found.collect()}
    assert got == {"A": (1, 8, 1, None, None), "B": (2, 4, 2, 4, 1), "C": (5, 6, 2, 9, 1), "E": (10, None, 1, None, None)}
    within = {(r.seq, r.tag) for r in marked.inside(ops.where("operator = 'Tj'").select("doc_id", "page_index", "seq"), found).collect()}
    assert within == {(3, "A"), (3, "B"), (11, "E")}


def test_actions_chains_and_labels(corpus):
    tree, root, pages = writer.page_tree(10, [b"", b"", b""])
    bodies = tree | {
        1: b"<< /Type /Catalog /Pages %d 0 R /PageLabels << /Nums [1 << /S /r >> 2 << /P (x) >>] >> >>" % root, 4: b"5 0 R", 5: b"6 0 R", 6: b"(end)", 7: b"8 0 R", 8: b"7 0 R",
        20: b"<< /S /URI /URI (http://a) /Next [21 0 R << /S /Named /N /NextPage >>] >>", 21: b"<< /S /Launch /F << /UF (u) /F (f) >> /Next 20 0 R >>",
    }
    known = corpus(writer.revision(b"", bodies, b"/Root 1 0 R", "hybrid"))
    spark = known.live.sparkSession
    rows = spark.createDataFrame([(1, 1, "20 0 R"), (1, 2, f"[{pages[1]} 0 R /Fit]")], "doc_id long, key int, action string")
    got = {(r.key, tuple(r.step)): (r.kind, r.uri, r.file, r.named) for r in navigation.actions(rows, known.live).collect()}
    assert got == {(1, (0,)): ("URI", "http://a", None, None), (1, (0, 0)): ("Launch", None, "u", None), (1, (0, 1)): ("Named", None, None, "NextPage"), (2, (0,)): ("GoTo", None, None, None)}
    chain = spark.createDataFrame([(1, "4 0 R"), (1, "7 0 R"), (1, "s:61")], "doc_id long, v string")
    assert sorted(str(r.v) for r in tables.chained(chain, known.live, "v").collect()) == ["None", "s:61", "s:656e64"]
    labels = navigation.page_labels(known.live, known.roots, known.pages)
    assert [r.label for r in labels.orderBy("page_index").collect()] == ["i", "ii", "x"]
    found = tables.pages_found(known.pages, labels, spark.createDataFrame([(1, "ii")], "doc_id long, label string"))
    assert [r.page_index for r in found.collect()] == [1]


def lines_of(spark, rects):
    return spark.createDataFrame([(1, 0, i, f"l{i}", *map(float, r)) for i, r in enumerate(rects)], "doc_id long, page_index int, line int, text string, x0 double, y0 double, x1 double, y1 double")


def test_boxes_columns_and_reading_order(spark):
    left = [(0, 100 - 12 * i, 90, 110 - 12 * i) for i in range(4)]
    right = [(200, 100 - 12 * i, 290, 110 - 12 * i) for i in range(4)]
    foot = [(0, 0, 290, 10)]
    df = lines_of(spark, [*left, *right, *foot])
    got = [(r.box, r.n_lines, r.text) for r in boxes.text_boxes(df).orderBy("box").collect()]
    assert got == [(0, 4, "l0\nl1\nl2\nl3"), (1, 4, "l4\nl5\nl6\nl7"), (2, 1, "l8")]
    flat = [r.text.split("\n")[0] for r in boxes.text_boxes(df, flow=None).orderBy("box").collect()]
    assert flat == ["l0", "l4", "l8"]
    para = {r.line: r.paragraph for r in boxes.paragraphs(df).collect()}
    assert para == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2}


def test_sub_paths_and_items(corpus):
    known = corpus(page_of(b"0 0 m 5 5 l 10 10 m 20 30 l S BI /W 1 /H 1 ID x EI"))
    runs = known.runs().cache()
    parts = [(r.part, r.bbox) for r in boxes.sub_paths(runs).orderBy("part").collect()]
    assert parts == [(0, [0, 0, 5, 5]), (1, [10, 10, 20, 30])]
    none = boxes.text_boxes(boxes.line_rows(boxes.layout.glyph_boxes(runs)))
    assert [r.kind for r in boxes.items(none, runs).orderBy("item").collect()] == ["path", "path", "image"]


def test_large_ranges_and_rectangles_stay_few_rows(spark):
    rng = random.Random(6)
    spans = [(i, a, a + rng.choice([0, 5, 300, 10**9])) for i in range(60) for a in (rng.randrange(2000),)]
    points = [(i, rng.randrange(4000)) for i in range(80)]
    df = ranges.range_lookup(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "r int, low long, high long"), "at", "low", "high", 16)
    assert sorted((r.p, r.r) for r in df.collect()) == sorted((p, r) for p, at in points for r, a, b in spans if a <= at <= b)
    rects = [(1, i, sorted_rect(rng)) for i in range(60)] + [(1, 100, [-1e7, -1e7, 1e7, 1e7]), (1, 101, [0.0, 0.0, 1e6, 1.0])]
    got = sorted((r.a, r.b) for r in ranges.spatial_pairs(spark.createDataFrame(rects, "page int, node int, rect array<double>"), ["page"], "node", "rect", 5.0).collect())
    want = sorted((i, j) for _, i, r in rects for _, j, s in rects if i < j and r[0] <= s[2] and s[0] <= r[2] and r[1] <= s[3] and s[1] <= r[3])
    assert got == want


def test_row_numbers_by_range(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, v int").repartition(3)
    whole = {r.id: r.n for r in sequences.numbered(df, ["v", "id"], "n").collect()}
    assert whole == {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, _, v in rows))}
    grouped = {r.id: r.n for r in sequences.numbered(df, ["v", "id"], "n", by="g").collect()}
    assert grouped == {i: n + 1 for g in range(9) for n, (_, i) in enumerate(sorted((v, i) for i, k, v in rows if k == g))}
    assert sequences.numbered(df.limit(0), ["v"], "n").count() == 0


def test_differences_and_snapshots(spark):
    schema = "k int, x double, name string, box array<double>"
    a = spark.createDataFrame([(1, 1.0, "a", [1.0, 2.0]), (2, 2.0, None, None), (3, 3.0, "c", [0.0]), (4, 1.0, "d", None)], schema)
    b = spark.createDataFrame([(1, 1.0 + 1e-8, "a", [1.0, 2.0 + 1e-9]), (2, 2.1, None, None), (3, 3.0, "x", [0.0, 1.0]), (5, 1.0, "e", None)], schema)
    got = {(r.k, r.column) for r in compare.differences(a, b, "k").collect()}
    assert got == {(2, "x"), (3, "name"), (3, "box"), (4, None), (5, None)}
    assert json.loads(compare.snapshot(a, "part", "k").where("key = '{\"k\":1}'").first().record) == {"x": 1.0, "name": "a", "box": [1.0, 2.0]}


def test_json_lines_and_page_digests(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, i, f"g{i}") for i in range(50)], "doc_id int, page_index int, index int, text string").repartition(4)
    sinks.write_json_lines(rows, str(tmp_path / "out"), "doc_id", "page_index", "index")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["index"] for x in lines] == list(range(50))
    one = sinks.page_digests(rows).first()
    each = "".join(hashlib.sha256(json.dumps({"doc_id": 1, "page_index": 0, "index": i, "text": f"g{i}"}, separators=(",", ":")).encode()).hexdigest() for i in range(50))
    assert one.n == 50 and one.digest == hashlib.sha256(each.encode()).hexdigest()


def test_colour_spaces_and_colours(spark):
    spaces = ["/DeviceRGB", '["/DeviceN", ["/A", "/B"], "/DeviceRGB"]', '["/ICCBased", {"N": 4}]', '["/Indexed", "/DeviceRGB", 5, "s:00"]', "/Nope"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(spaces)], "i int, s string").select("i", pictures.described(F.col("s")).alias("d"))
    assert {r.i: r.d and (r.d.name, r.d.components) for r in rows.collect()} == {0: ("DeviceRGB", 3), 1: ("DeviceN", 2), 2: ("ICCBased", 4), 3: ("Indexed", 1), 4: None}
    made = spark.range(1).select(
        pictures.made_color(F.array(F.lit("0.5")), F.lit(3), F.lit(None).cast("int")).alias("a"), pictures.made_color(F.array(F.lit("2.5")), F.lit(1), F.lit(2)).alias("b")
    ).first()
    assert made.a == [0.5, 0.0, 0.0] and made.b == [2.0]


def test_fonts_are_found_by_their_own_names(corpus):
    extra = b"/Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Own /FontDescriptor << /Flags 4 /Ascent 700 /FontFile 9 0 R >> >> >> >>"
    row = pictures.fonts(*(lambda c: (c.live, c.resources))(corpus(page_of(b"", extra)))).first()
    assert (row.name, row.kind, row.embedded, row.flags, row.ascent) == ("Own", "Type1", True, 4, 700.0)


@pytest.mark.parametrize("style", ["table", "stream", "hybrid"])
def test_command_line_modes(spark, tmp_path, style):
    from pagequarry import __main__ as cli

    tree, root, _ = writer.page_tree(10, [b"/Contents 3 0 R", b""], b"/Resources << /Font << /F1 << /Type /Font /BaseFont /Helvetica >> >> >>")
    bodies = tree | {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: writer.stream(b"BT /F1 9 Tf 5 5 Td (hello) Tj ET")}
    (tmp_path / "a.pdf").write_bytes(writer.revision(b"", bodies, b"/Root 1 0 R", style))
    got = {m: [r.asDict() for r in cli.shown(spark, m, str(tmp_path)).collect()] for m in ("text", "labels", "fonts")}
    assert [r["text"] for r in got["text"]] == ["hello"] and [r["label"] for r in got["labels"]] == ["1", "2"] and got["fonts"][0]["name"] == "Helvetica"
    assert cli.shown(spark, "labels", str(tmp_path), [1]).count() == 1
