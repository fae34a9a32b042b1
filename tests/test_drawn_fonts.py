"""Type 3 fonts: their own resources hold fonts, and their procedures are read to the end."""

from pagequarry.operators import images, resources
from pagequarry.sources import writer


def drawn(procedures: dict[str, bytes]) -> bytes:
    """A page with a Type 3 font whose resources name a font, itself, and a Type 3 font that is written out and names one more."""
    names = b" ".join(b"/%s %d 0 R" % (n.encode(), 50 + i) for i, n in enumerate(procedures))
    inner = b"<< /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /CharProcs << >> /Resources << /Font << /D << /Type /Font /Subtype /Type1 /BaseFont /Symbol >> >> >> >>"
    font = b"<< /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /CharProcs << %s >> /Resources 7 0 R >>" % names
    tree, root, _ = writer.page_tree(10, [b"/Resources << /Font << /A 5 0 R >> >>"])
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 5: font, 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>", 7: b"<< /Font << /B 6 0 R /A 5 0 R /C %s >> >>" % inner}
    return writer.revision(b"", bodies | tree | {50 + i: writer.stream(p) for i, p in enumerate(procedures.values())}, b"/Root 1 0 R")


def test_fonts_of_a_fonts_own_resources_are_found(corpus):
    c = corpus(drawn({"a": b"10 0 d0"}))
    found = images.fonts(c.live, resources.on_pages(resources.shared(c.live, c.pages, drawn=True), c.pages))
    assert sorted((r["name"], r["kind"]) for r in found.collect()) == [("A", "Type3"), ("C", "Type3"), ("Courier", "Type1"), ("Symbol", "Type1")]


def test_procedures_are_read_to_their_end(corpus):
    c = corpus(drawn({"a": b"10 0 d0 0 0 5 5 re f", "b": b"10 0 d0 0 0 5 5 re f (open", "c": b"20 0 0 9 8 1 d1 <41", "d": b"0 0 m", "e": b""}))
    found = {r["glyph"]: (r["width"], r["bbox"], bool(r["error"])) for r in resources.char_procs(c.live, c.shared).collect()}
    assert found == {"a": (10.0, None, False), "b": (None, None, True), "c": (None, None, True), "d": (None, None, False), "e": (None, None, True)}
