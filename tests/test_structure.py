from pagequarry.operators import structure

CONTENT = b"BT /F1 10 Tf /P << /MCID 0 >> BDC (Hello ) Tj (world) Tj EMC /P << /MCID 1 >> BDC (so\xadft) Tj EMC ET"
PDF = b"""%%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R /StructTreeRoot 5 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 10 20] /Resources << /Font << /F1 << /BaseFont /Helvetica >> >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /StructParents 7 >> endobj
4 0 obj << /Length %d >> stream
%s
endstream endobj
5 0 obj << /K 6 0 R /RoleMap << /Chapter /Sect >> /ParentTree 10 0 R >> endobj
6 0 obj << /S /Chapter /P 5 0 R /Pg 3 0 R /T (One) /K [7 0 R 8 0 R] >> endobj
7 0 obj << /S /P /P 6 0 R /K 0 >> endobj
8 0 obj << /S /P /P 6 0 R /K [<< /Type /MCR /MCID 1 /Pg 3 0 R >> 9 0 R] >> endobj
9 0 obj << /S /Span /P 8 0 R /ActualText (given) >> endobj
10 0 obj << /Kids [11 0 R] >> endobj
11 0 obj << /Nums [7 [7 0 R null 8 0 R]] >> endobj
trailer << /Root 1 0 R /Size 12 >>
""" % (len(CONTENT), CONTENT)


def test_structure(corpus):
    known = corpus(PDF)
    live, roots, pages = known.live, known.roots, known.pages
    elems = structure.elements(live, roots).cache()
    got = [(r.node, r.parent, r.depth, r.role, r.raw_role, r.page_obj) for r in elems.orderBy("dfs_index").collect()]
    assert got == [(6, None, 0, "Sect", "Chapter", 3), (7, 6, 1, "P", "P", 3), (8, 6, 1, "P", "P", 3), (9, 8, 2, "Span", "Span", 3)]
    content = structure.contents(live, elems).cache()
    assert {(r.node, r.page_obj, r.mcid) for r in content.collect()} == {(7, 3, 0), (8, 3, 1)}
    slots = [(r.page_index, r.mcid, r.node) for r in structure.parent_slots(live, roots, pages).orderBy("mcid").collect()]
    assert slots == [(0, 0, 7), (0, 1, None), (0, 2, 8)]
    text = {r.node: r.text for r in structure.element_text(elems, content, pages, known.runs()).collect()}
    assert text == {6: "", 7: "Hello world", 8: "soft", 9: "given"}
