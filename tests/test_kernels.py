import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.kernels import content, document, filters, fonts, syntax
from pagequarry.sources import render


def values(data: bytes):
    return syntax.Values(data).read()


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"<< /A 1 /B [1 .5 -2 true null (x\\)y)] /C 3 0 R /D <48 6> >>", {"A": 1, "B": [1, 0.5, -2, True, None, "s:782979"], "C": "3 0 R", "D": "s:4860"}),
        (b"/Name#20x", "/Name x"),
        (b"(a(b)c\\101\\\n)", "s:6128622963" + "41"),
        (b"% note\n42", 42),
        (b"[1 0 R 2 0]", ["1 0 R", 2, 0]),
    ],
)
def test_values(data, want):
    assert values(data) == want


@given(st.binary(max_size=300))
@settings(max_examples=80, deadline=None)
def test_strings_round_trip(raw):
    escaped = render.escaped(raw)
    assert values(escaped) == "s:" + raw.hex()


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_malformed_bytes_never_raise(raw):
    list(syntax.indirect_objects(b"1 0 obj " + raw))
    list(content.operations(raw))


def built(*bodies, tail=None, gap=b""):
    """A document of numbered bodies with a classic table, and the offset of each object."""
    out, offsets = b"%PDF-1.6\n", []
    for i, body in enumerate(bodies):
        offsets.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (i + 1, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start), offsets, start


def live(data):
    rows = list(document.read(data))
    found = {r["obj"]: (json.loads(r["value"]), r["repaired"]) for r in rows if r["kind"] == "object" and r["live"]}
    return found, next(r["error"] for r in rows if r["kind"] == "document"), rows


def test_newer_entries_replace_free_and_add():
    data, offsets, start = built(b"<< /Type /Catalog >>", b"(old)", b"(gone)")
    at = len(data)
    data += b"2 0 obj (new) endobj 4 0 obj (more) endobj\n"
    table = len(data)
    data += b"xref\n2 1\n%010d 00000 n \n3 2\n0000000000 00001 f \n%010d 00000 n \n" % (at, at + 21)
    data += b"trailer << /Size 5 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (start, table)
    found, error, rows = live(data)
    assert error is None and {k: v for k, (v, _) in found.items()} == {1: {"Type": "/Catalog"}, 2: "s:6e6577", 3: "s:676f6e65", 4: "s:6d6f7265"}
    assert [(r["rev"], r["obj"], r["free"]) for r in rows if r["kind"] == "entry"] == [(0, 2, False), (0, 3, True), (0, 4, False), (1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False)]
    state = json.loads(next(r["value"] for r in rows if r["kind"] == "document"))
    assert state["trailer"]["Root"] == "1 0 R" and state["trailer"]["Size"] == 5 and state["version"] == "1.6"


def test_streams_of_entries_and_packed_objects():
    head = b"%PDF-1.5\n1 0 obj << /Type /Catalog >> endobj\n"
    body = b"5 0 6 3 42 [1]"
    packed = b"2 0 obj << /Type /ObjStm /N 2 /First 8 /Length %d /Filter 7 0 R >> stream\n%s\nendstream endobj\n" % (len(body.hex()) + 1, body.hex().encode() + b">")
    other = b"7 0 obj /ASCIIHexDecode endobj\n"
    at = len(head + packed + other)
    entries = [(0, 0, 65535), (1, 9, 0), (1, len(head), 0), (1, at, 0), (0, 0, 0), (2, 2, 0), (2, 2, 1), (1, len(head + packed), 0)]
    raw = zlib.compress(b"".join(bytes([k]) + w.to_bytes(2, "big") + i.to_bytes(2, "big") for k, w, i in entries))
    table = b"3 0 obj << /Type /XRef /Size 8 /W [1 2 2] /Root 1 0 R /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(raw), raw)
    found, error, _ = live(head + packed + other + table + b"startxref\n%d\n%%%%EOF" % at)
    assert error is None and found[5] == (42, False) and found[6] == ([1], False) and set(found) == {1, 2, 3, 5, 6, 7}


def test_recovery_keeps_the_first_declaration():
    data, *_ = built(b"<< /Type /Catalog >>", b"(first)")
    data = data.replace(b"startxref", b"startxerf") + b"2 0 obj (second) endobj trailer << /Root 1 0 R >>"
    found, error, _ = live(data)
    assert "startxref" in error and found[2] == ("s:6669727374", False)


def test_stale_entries_are_repaired_and_cycles_are_errors():
    data, offsets, start = built(b"<< /Type /Catalog >>", b"(two)")
    stale = data.replace(b"%010d 00000 n \n" % offsets[1], b"%010d 00000 n \n" % (offsets[1] + 3))
    found, error, _ = live(stale)
    assert error is None and found[2] == ("s:74776f", True)
    cyclic = data.replace(b"/Size 3", b"/Size 3 /Prev %d" % start)
    assert "cycle" in live(cyclic)[1] and live(data.replace(b"/Size 3", b"/Size 2"))[1].startswith("object 2 is beyond")


def test_text_encodings():
    assert syntax.text_of(b"\x80 \xa0 \x92") == "• € ™" and syntax.text_of(b"\xfe\xff\x20\xac\x00") == "€" and syntax.text_of(b"\xef\xbb\xbf\xc3\xa9") == "é"


def test_malformed_filters_never_raise_other_errors():
    for spec in ({"Filter": "/FlateDecode", "DecodeParms": "5 0 R"}, {"Filter": 3}, {"Filter": "/LZWDecode", "DecodeParms": {"Predictor": "6 0 R"}}, {"Filter": "/DCTDecode"}):
        with pytest.raises(filters.FilterIssue):
            filters.decode(zlib.compress(b"x") if spec["Filter"] == "/FlateDecode" else b"\x80\x0b\x60\x50", spec)
    damaged = zlib.compress(b"some text that is long enough " * 40)[:-30]
    assert filters.decode(damaged + b"\0" * 30, {"Filter": "/FlateDecode"}, lenient=True).startswith(b"some text")


def test_objects_in_source_order_keep_revisions_and_errors():
    data = b"%PDF-1.4\n1 0 obj 1 endobj 1 0 obj 2 endobj 2 0 obj (open endobj"
    rows = list(syntax.indirect_objects(data))
    assert [(r["obj"], r["value"]) for r in rows] == [(1, 1), (1, 2), (2, None)] and rows[2]["error"]


def test_stream_with_wrong_length_is_found_by_its_end():
    row = next(syntax.indirect_objects(b"4 0 obj << /Length 999 >> stream\nabc\nendstream endobj"))
    assert row["stream"] == b"abc"


def lzw_pack(codes, size=9):
    bits = "".join(format(c, f"0{size}b") for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_filters():
    assert filters.lzw(lzw_pack([256, 45, 258, 258, 65, 259, 66, 257])) == b"-----A---B"
    assert filters.ascii_hex(b"48 65 6C6>junk") == b"Hel`"
    assert filters.ascii_85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    with pytest.raises(filters.FilterIssue):
        filters.run_length(b"\x00a")
    chain = {"Filter": ["/ASCIIHexDecode", "/FlateDecode"]}
    assert filters.decode(zlib.compress(b"data").hex().encode() + b">", chain) == b"data"
    with pytest.raises(filters.FilterIssue):
        filters.decode(b"", {"Filter": "/Nope"})


@given(st.integers(1, 4), st.integers(1, 5), st.integers(1, 6), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_png_rows_undo_their_filters(colors, columns, rows, seed):
    rng = np.random.default_rng(seed)
    row = colors * columns
    pixels = rng.integers(0, 256, (rows, row)).astype(np.int64)
    coded = bytearray()
    for y in range(rows):
        tag = int(rng.integers(0, 5))
        coded.append(tag)
        for x in range(row):
            left = pixels[y, x - colors] if x >= colors else 0
            up = pixels[y - 1, x] if y else 0
            corner = pixels[y - 1, x - colors] if y and x >= colors else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            coded.append(int(pixels[y, x] - (0, left, up, (left + up) // 2, paeth)[tag]) & 255)
    assert filters.predict(bytes(coded), 15, colors, 8, columns) == pixels.astype(np.uint8).tobytes()


def run(data: bytes, **f):
    return list(content.Machine({"F1": fonts.font_of({"BaseFont": "/Helvetica", "Encoding": "/WinAnsiEncoding"} | f, None)}).run(data))


def test_text_placement():
    rows = run(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 7 Td (A ) Tj [(B) -1000 (C)] TJ ET Q (late) Tj")
    first, second = rows[0], rows[1]
    assert (first["x"], first["y"]) == (20, 34) and "".join(first["glyphs"][0]) == "A "
    assert second["x"] == pytest.approx(20 + 2 * (6.67 + 2.78))
    assert second["glyphs"][1][1] == pytest.approx(second["x"] + 2 * (6.67 + 10))


def test_marks_paths_and_images():
    rows = run(b"/P <</MCID 3>> BDC 0 0 10 5 re f EMC EMC /Span BMC 1 0 0 1 5 5 cm BI /W 1 /H 1 ID x EI /X Do 0 0 m 1 1 l n")
    assert [r["kind"] for r in rows] == ["path", "image", "xobject"]
    assert rows[0]["marked"][0]["mcid"] == 3 and rows[0]["bbox"] == [0, 0, 10, 5] and rows[0]["fill"]
    assert rows[1]["marked"][0]["tag"] == "Span" and rows[1]["bbox"] == [5, 5, 6, 6] and rows[2]["name"] == "X"


def test_fonts():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <00660069> endbfchar 1 beginbfrange <42> <43> <0061> endbfrange"
    f = fonts.font_of({"Subtype": "/Type1", "Widths": [500], "FirstChar": 65}, cmap)
    assert [(t, w) for t, _, w, _ in f.glyphs(b"ABC")] == [("fi", 0.5), ("a", 0.0), ("b", 0.0)]
    wide = fonts.font_of({"Subtype": "/Type0", "DW": 900, "W": [1, [100, 200], 5, 6, 300]}, None)
    assert [w for _, _, w, _ in wide.glyphs(b"\0\1\0\2\0\3\0\6")] == [0.1, 0.2, 0.9, 0.3]
    named = fonts.font_of({"Encoding": {"Differences": [65, "/uni0041", "/u1F600", "/f_i.alt"]}}, None)
    assert [g[0] for g in named.glyphs(b"ABC")] == ["A", "\U0001f600", "fi"]
