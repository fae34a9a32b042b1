"""Character maps laid over one another, predefined encodings, vertical and Type 3 metrics, selection in the page fold."""

import random

from pagequarry.kernels import cmaps, content, fonts, syntax


def test_overlays_against_a_table_of_codes():
    rng = random.Random(4)
    for _ in range(300):
        ranges = []
        for k in range(rng.randint(0, 12)):
            n = rng.choice([1, 1, 2])
            low = rng.randint(0, 60)
            ranges.append((n, low, low + rng.choice([0, 0, 3, 10, 40]), 1000 * k))
        table = {(n, c): t + c - low for n, low, high, t in ranges for c in range(low, high + 1)}
        m = cmaps.CMap(cids=ranges)
        assert {(n, c): m.cid(n, c) for n in (1, 2) for c in range(110)} == {(n, c): table.get((n, c), 0) for n in (1, 2) for c in range(110)}
        flat = cmaps.flattened(ranges)
        assert all(a[:2] <= b[:2] and (a[0] < b[0] or a[2] < b[1]) for a, b in zip(flat, flat[1:]))


def test_wide_ranges_stay_below_later_ones():
    m = cmaps.parse(b"1 begincidrange <000000> <FFFFFF> 0 endcidrange 1 begincidrange <050000> <05FFFF> 7 endcidrange")
    assert m.cid(3, 200000) == 200000 and m.cid(3, 0x050001) == 8 and m.cid(3, 0x060000) == 0x060000


def test_parents_and_predefined_encodings():
    low = cmaps.parse(b"begincodespacerange <00> <FF> endcodespacerange begincidrange <00> <FF> 100 endcidrange")
    top = cmaps.parse(b"/Low usecmap begincidchar <41> 5 endcidchar")
    m = cmaps.overlaid([low], top)
    assert top.base == "Low" and [m.cid(*c) for c in m.codes(b"AB")] == [5, 166]
    for name, text in (("90ms-RKSJ-H", "日本a"), ("GBK-EUC-H", "中文x"), ("UniJIS-UTF16-H", "日𠮷"), ("KSCms-UHC-V", "한글"), ("ETen-B5-H", "中文")):
        f = fonts.font_of({"Subtype": "/Type0", "Encoding": "/" + name, "DescendantFonts": [{}]}, None)
        assert "".join(g[0] for g in f.glyphs(text.encode(cmaps.predefined_codec(name)))) == text and f.vertical == name.endswith("V")
    unknown = fonts.font_of({"Subtype": "/Type0", "Encoding": "/Identity-H", "DescendantFonts": [{"DW": 400}]}, None)
    assert [(t, cid, w) for t, cid, w, _ in unknown.glyphs(b"\0A\0B")] == [("", 65, 0.4), ("", 66, 0.4)]


def test_streams_end_alone_and_errors_are_told():
    first, second = b"q (a) Tj (open", b"/T gs (b) Tj 1 0 0"
    data = first + b"\n" + second + b"\n1 5 5 cm"
    cuts = [len(first) + 1, len(first) + len(second) + 2]
    got = list(content.operations(data, cuts))
    assert [(op, a) for op, a, _ in got if op != "error"] == [("q", []), ("Tj", ["s:61"]), ("gs", ["/T"]), ("Tj", ["s:62"]), ("cm", [1, 0, 0, 1, 5, 5])]
    assert [a[0] for op, a, _ in got if op == "error"] == ["unterminated string at 9"]
    assert [data[at : at + 2] for op, _, at in got if op == "Tj"] == [b"Tj", b"Tj"]


def test_kinds_and_operators_reach_the_fold():
    data = b"BT /F 10 Tf 0 0 Td (x) Tj [(y)] TJ ET 0 0 5 5 re f 1 1 2 2 re S /Im Do /Fm Do"
    scope = content.Scope(images={"Im"})

    def kinds(**given):
        return [(r["kind"], r.get("name")) for r in content.Machine(scopes={0: scope}, **given).run(data)]

    assert kinds() == [("text", "F"), ("text", "F"), ("path", "f"), ("path", "S"), ("image", "Im"), ("xobject", "Fm")]
    assert kinds(kinds=frozenset({"path"})) == [("path", "f"), ("path", "S")]
    assert kinds(operators=frozenset({"TJ", "S"})) == [("text", "F"), ("path", "S")]
    assert kinds(flatten=True, kinds=frozenset({"image", "xobject"})) == [("image", "Im")]
    (shown,) = content.Machine(operators=frozenset({"TJ"})).run(data)
    assert shown["x"] > 0  # what is not wanted still moves the text position


def test_comments_and_strings_hold_no_objects():
    data = b"%PDF-1.7\n% 5 0 obj (ghost) endobj\n(6 0 obj 1 endobj (7 0 obj) ) 5 0 obj (real) endobj\n( 8 0 obj 3 endobj"
    assert [(r["obj"], r["value"]) for r in syntax.indirect_objects(data)] == [(5, "s:7265616c"), (8, 3)]
