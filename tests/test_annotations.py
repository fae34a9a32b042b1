"""Annotations: what they name is followed, what is malformed says so, and values are read once."""

from pagequarry.kernels import syntax
from pagequarry.operators import navigation
from pagequarry.sources import writer

NOTES = [
    b"<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (http://a.b/1) >> /F 4 /C [1 0 0] >>", b"<< /Subtype /Link /Rect [1 2 3 4] /A 60 0 R >>", b"<< /Subtype /Link /Rect [1 2 3 4] /A 99 0 R >>",
    b"<< /Subtype /Text /Rect [1 2 3 4] /Contents <FEFF00e90020> /M (D:2020) /F 1.5 >>", b"<< /Rect [1 2 3 4] >>", b"<< /Subtype /Highlight /Rect [1 2 3] /QuadPoints [0 0 0 0 0 0 0 0] >>",
    b"<< /Subtype /Highlight /Rect [1 2 3 4] /QuadPoints [0 0] /A null >>", b"[ 1 2 ]", b"(text)", b"<< /Subtype (s) /Rect [1 2 3 4] /C [] /A (x) >>",
]


def noted() -> bytes:
    tree, root, _ = writer.page_tree(100, [b"/Annots 2 0 R", b"/Annots [10 0 R 77 0 R << /Subtype /Popup /Rect [0 0 1 1] /A 60 0 R >>]", b"/Annots 10 0 R", b""])
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 2: writer.refs(range(10, 10 + len(NOTES))), 60: b"<< /S /GoTo /URI (apart) >>"}
    return writer.revision(b"", bodies | tree | {10 + i: n for i, n in enumerate(NOTES)}, b"/Root 1 0 R")


def test_annotations_and_what_they_name(corpus):
    c = corpus(noted())
    found = navigation.annotations(c.live, c.pages)
    got = {(r["page_index"], r["seq"]): (r["subtype"], r["contents"], r["action_kind"], r["uri"], r["modified"], r["flags"], r["color"], r["error"]) for r in found.collect()}
    assert got == {
        (0, 0): ("Link", None, "URI", "http://a.b/1", None, 4, [1.0, 0.0, 0.0], None), (0, 1): ("Link", None, "GoTo", "apart", None, 0, None, None), (0, 2): ("Link", None, None, None, None, 0, None, None),
        (0, 3): ("Text", "é ", None, None, "D:2020", 0, None, None), (0, 4): (None, None, None, None, None, 0, None, "Subtype"), (0, 5): ("Highlight", None, None, None, None, 0, None, "Rect"),
        (0, 6): ("Highlight", None, None, None, None, 0, None, "QuadPoints"), (0, 7): (None, None, None, None, None, 0, None, "Subtype"), (0, 8): (None, None, None, None, None, 0, None, "Subtype"),
        (0, 9): ("s", None, None, None, None, 0, None, "Subtype"),
        (1, 0): ("Link", None, "URI", "http://a.b/1", None, 4, [1.0, 0.0, 0.0], None), (1, 1): (None, None, None, None, None, 0, None, "Subtype"), (1, 2): ("Popup", None, "GoTo", "apart", None, 0, None, None),
    }


def test_values_of_annotations_are_taken_out_once(corpus):
    c = corpus(noted().replace(b"/A 60 0 R", b"/B 60 0 R").replace(b"/A 99 0 R", b"/B 99 0 R"))
    plan = navigation.annotations(c.live, c.pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "Join" not in plan


def test_values_with_strings_have_shapes():
    for note in NOTES[:4]:
        if b"." in note.replace(b"a.b", b""):
            continue
        value = syntax.Values(note).read()
        assert syntax.simple(note, 0, len(note)) and syntax.shaped(note) == (value, syntax._json(value))
    assert syntax.shaped(b"[(100000000) 100000001 <41> <4> ()]")[0] == ["s:" + b"100000000".hex(), 100000001, "s:41", "s:40", "s:"]
    for other in (b"[-0]", b"[007]", b"[(a(b))]", b"[1.5]", b"[(a]", b"<< /A1 (x) /A2 (y) >>"):
        assert syntax.shaped(other) is None
