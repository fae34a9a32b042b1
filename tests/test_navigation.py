import pytest

from pagequarry.operators import navigation

PDF = b"""%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /Names << /Dests 9 0 R >> /AcroForm << /Fields [20 0 R] >> >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 10 20] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Annots [15 0 R << /Subtype /Text >> << /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI (http://x) >> /F 4 /C [1 0 0] >>] >> endobj
5 0 obj << /Type /Outlines /First 6 0 R /Last 7 0 R >> endobj
6 0 obj << /Title (One) /Parent 5 0 R /Next 7 0 R /First 8 0 R /Dest [3 0 R /Fit] >> endobj
7 0 obj << /Title <FEFF00540077> /Parent 5 0 R /Prev 6 0 R >> endobj
8 0 obj << /Title (Inner) /Parent 6 0 R >> endobj
9 0 obj << /Kids [10 0 R 11 0 R] >> endobj
10 0 obj << /Names [(a) [3 0 R /XYZ 1 2 0] (b) [3 0 R /XYZ 1]] >> endobj
11 0 obj << /Names [(a) [3 0 R /Fit] (c) 12 0 R] >> endobj
12 0 obj << /D [3 0 R /FitH 7] >> endobj
15 0 obj << /Subtype /Note /Rect [1 2 3 4] /Contents (hi) /M (D:2020) >> endobj
20 0 obj << /T (person) /FT /Tx /Kids [21 0 R 22 0 R] >> endobj
21 0 obj << /T (name) /Parent 20 0 R /V (Ann) >> endobj
22 0 obj << /T (city) /FT /Ch /Parent 20 0 R /Opt [(x) [(y) (Why)]] /Ff 3 >> endobj
trailer << /Root 1 0 R /Size 30 >>
"""


@pytest.fixture(scope="module")
def known(corpus):
    return corpus(PDF)


def test_outline_in_depth_first_order(known):
    got = [(r.title, r.depth, r.path) for r in navigation.outline(known.live, known.roots).orderBy("place").collect()]
    assert got == [("One", 0, "One"), ("Inner", 1, "One / Inner"), ("Tw", 0, "Tw")]


def test_destinations_first_name_wins_and_arity(known):
    got = {r.name: (r.page_obj, r.view, r.params) for r in navigation.destinations(known.live, known.roots).collect()}
    assert got == {"a": (3, "XYZ", [1.0, 2.0, 0.0]), "b": (3, None, None), "c": (3, "FitH", [7.0])}


def test_annotations_report_what_they_lack(known):
    got = [(r.subtype, r.contents, r.uri, r.flags, r.color, r.error) for r in navigation.annotations(known.live, known.pages).orderBy("seq").collect()]
    assert got == [("Note", "hi", None, 0, None, None), ("Text", None, None, 0, None, "Rect"), ("Link", None, "http://x", 4, [1.0, 0.0, 0.0], None)]


def test_form_fields_inherit(known):
    got = {r.full_name: (r.field_type, r.flags, r.value, r.options) for r in navigation.form_fields(known.live, known.roots).collect()}
    assert got == {"person": ("Tx", 0, None, None), "person.name": ("Tx", 0, "Ann", None), "person.city": ("Ch", 3, None, ["x", "Why"])}
