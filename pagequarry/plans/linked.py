"""Queries over links between objects and over bounded trees: documents written from customers' orders."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import bounded, boxes, graph, layout, navigation, resources, structure
from pagequarry.operators.tables import field, ref
from pagequarry.plans.documents import Parsed
from pagequarry.plans.relational import table
from pagequarry.plans.structured import STYLES
from pagequarry.sources import writer
from pagequarry.sources.store import written
from pagequarry.sources.writer import json_value, page_tree, refs, revision

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its DuckDB equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders_by_customer(spark, sf_dir, build) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return writer.per_document(orders, build)


ORDERS = "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS s, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
# Objects of an order begin at first + 4 i: note, popup, element, loose object.
FIRST = "(11 + greatest((n + 7) // 8, 1) + 10)"


def noted(doc_id: int, rows: list[dict]) -> bytes:
    """A note an order with its popup, a reply to the order before, and an element that holds it; finished orders leave an object that nothing names."""
    n = len(rows)
    tree, root, pages = page_tree(10, [b"/Annots 2 0 R"])
    first = 11 + max((n + 7) // 8, 1) + 10
    bodies, notes = {}, []
    for i, r in enumerate(rows):
        note = first + 4 * i
        notes += [note, note + 1]
        value = {"Subtype": "/Text", "Rect": [0, 0, 1, 1], "Popup": f"{note + 1} 0 R", "P": f"{pages[0]} 0 R", "StructParent": i}
        if i:
            value["IRT"] = f"{note - 4} 0 R"
        bodies[note] = json_value(value)
        bodies[note + 1] = json_value({"Subtype": "/Popup", "Rect": [0, 0, 1, 1], "Parent": f"{note} 0 R"})
        bodies[note + 2] = json_value({"S": "/Annot", "P": "4 0 R", "K": [{"Type": "/OBJR", "Obj": f"{note} 0 R", "Pg": f"{pages[0]} 0 R"}]})
        if r["status"] == "F":
            bodies[note + 3] = json_value({"Order": r["ord"], "Note": f"{note} 0 R"})
    elements = [f"{first + 4 * i + 2} 0 R" for i in range(n)]
    outline = {"Title": "last", "Parent": "5 0 R", "SE": elements[-1]}
    bodies |= {
        1: b"<< /Type /Catalog /Pages %d 0 R /StructTreeRoot 3 0 R /Outlines 5 0 R >>" % root, 2: refs(notes), 3: json_value({"K": "4 0 R"}),
        4: json_value({"S": "/Document", "P": "3 0 R", "K": elements}), 5: json_value({"First": "6 0 R", "Last": "6 0 R"}), 6: json_value(outline),
    }
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(ORDERS + f""", b AS (SELECT *, {FIRST} + 4 * i AS note FROM o)
    SELECT doc_id, (2 * i)::INTEGER AS seq, unnest(['popup', 'page', 'element']) AS link, unnest([note + 1, 10, note + 2])::INTEGER AS target FROM b
    UNION ALL SELECT doc_id, (2 * i)::INTEGER, 'reply_to', (note - 4)::INTEGER FROM b WHERE i > 0
    UNION ALL SELECT doc_id, (2 * i)::INTEGER, 'reply', (note + 4)::INTEGER FROM b WHERE i + 1 < n
    UNION ALL SELECT doc_id, (2 * i + 1)::INTEGER, 'parent', note::INTEGER FROM b""")
def pdf_annotation_links(spark, sf_dir):
    """Popups, replies, pages and structure elements of annotations, in both directions."""
    p = Parsed(orders_by_customer(spark, sf_dir, noted))
    links = written(graph.edges(p.live), "edges")
    return graph.annotation_links(p.live, p.pages, links).select("doc_id", "seq", "link", "target")


@query(ORDERS + f", b AS (SELECT *, {FIRST} + 4 * i AS note FROM o) SELECT doc_id, (note + 3)::INTEGER AS obj, k AS order_key FROM b WHERE s = 'F'")
def pdf_unreachable_objects(spark, sf_dir):
    """Objects that nothing leads to from the trailer."""
    p = Parsed(orders_by_customer(spark, sf_dir, noted))
    found = graph.unreachable(p.live, written(graph.edges(p.live), "edges"), p.roots)
    return found.select("doc_id", "obj", field("value", "Order").cast("long").alias("order_key"))


@query(ORDERS + f""", b AS (SELECT *, {FIRST} + 4 * i AS note FROM o), e AS (SELECT doc_id, note + 2 AS obj, i, n FROM b)
    SELECT doc_id, n::BIGINT AS n_elements, (n - 1)::INTEGER AS element_place, (4 + 3 * n + 2 + 2)::BIGINT AS n_reached, 3::INTEGER AS steps_to_first FROM e WHERE i = n - 1""")
def pdf_outline_elements(spark, sf_dir):
    """The element that each outline item names, its place among the document's, and how far the catalog's references lead."""
    p = Parsed(orders_by_customer(spark, sf_dir, noted))
    links = written(graph.edges(p.live), "edges")
    nodes = navigation.outline(p.live, p.roots)
    elems = structure.elements(p.live, p.roots).select("doc_id", F.col("node").alias("element"), (F.col("dfs_index") - 1).alias("element_place"), "parent")
    named = graph.outline_elements(nodes, links).join(elems, ["doc_id", "element"])
    count = elems.where("parent IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_elements"), F.min("element").alias("first"))
    reached = written(graph.reachable(links, p.roots.select("doc_id", F.col("root").alias("obj"))), "reached")
    total = reached.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_reached"))
    steps = reached.select("doc_id", F.col("obj").alias("first"), F.col("steps").alias("steps_to_first"))
    found = named.join(count, "doc_id").join(total, "doc_id").join(steps, ["doc_id", "first"])
    return found.select("doc_id", "n_elements", F.col("element_place").cast("int").alias("element_place"), "n_reached", "steps_to_first")


# --- bounded trees: orders as names, four a leaf, three leaves a branch

def branched(doc_id: int, rows: list[dict]) -> bytes:
    """By doc_id: sound; the last leaf's first two names in the wrong order; the first leaf's limits too narrow; a branch without limits."""
    how, names = doc_id % 4, [f"order{r['ord']:010d}" for r in rows]
    leaves = [names[p : p + 4] for p in range(0, len(names), 4)]
    bodies, at = {}, 10
    level = []
    for k, own in enumerate(leaves):
        listed, low, high = list(own), own[0], own[-1]
        if how == 1 and k == len(leaves) - 1 and len(own) > 1:
            listed[:2] = listed[1::-1]
        if how == 2 and k == 0 and len(own) > 1:
            low = own[1]
        bodies[at] = json_value({"Limits": [low, high], "Names": [x for name in listed for x in (name, f"to {name[5:]}")]})
        level.append((at, own[0], own[-1]))
        at += 1
    branches = []
    for p in range(0, len(level), 3):
        kids = level[p : p + 3]
        limits = {} if how == 3 and p == 0 else {"Limits": [kids[0][1], kids[-1][2]]}
        bodies[at] = json_value(limits | {"Kids": [f"{k} 0 R" for k, _, _ in kids]})
        branches.append(at)
        at += 1
    bodies |= {1: b"<< /Type /Catalog /Names << /Dests 2 0 R >> >>", 2: json_value({"Kids": [f"{k} 0 R" for k in branches]})}
    return revision(b"", bodies, b"/Root 1 0 R", STYLES[doc_id % 3])


def dests_root(p: Parsed) -> DataFrame:
    return p.roots.select("doc_id", ref(field("catalog", "Names", "Dests")).alias("node"))


@query(ORDERS + """, l AS (SELECT DISTINCT doc_id, n, (n + 3) // 4 AS leaves, (n - 1) % 4 + 1 AS in_last FROM o)
    SELECT doc_id, (10 + leaves - 1)::INTEGER AS node, 'keys unsorted' AS problem FROM l WHERE doc_id % 4 = 1 AND in_last > 1
    UNION ALL SELECT doc_id, 10, 'keys outside the limits' FROM l WHERE doc_id % 4 = 2 AND n > 1
    UNION ALL SELECT doc_id, (10 + leaves)::INTEGER, 'no limits' FROM l WHERE doc_id % 4 = 3""")
def pdf_tree_problems(spark, sf_dir):
    """Nodes of name trees whose keys or limits are wrong."""
    p = Parsed(orders_by_customer(spark, sf_dir, branched))
    return bounded.problems(p.live, dests_root(p), bounded.NAMES)


@query(ORDERS + """ SELECT doc_id, 'order' || lpad((k + CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END)::VARCHAR, 10, '0') AS name,
    CASE WHEN i % 2 = 0 AND NOT (doc_id % 4 = 2 AND i = 0 AND n > 1) OR EXISTS (FROM o x WHERE x.doc_id = o.doc_id AND x.k = o.k + 1 AND o.i % 2 = 1) THEN
        'to ' || lpad((k + CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END)::VARCHAR, 10, '0') END AS value FROM o""")
def pdf_tree_lookups(spark, sf_dir):
    """Many names looked up at once; every second one is not there (or is the next order's), and one that its leaf's limits deny is not found."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), F.col("o_orderkey").alias("k"))
    p = Parsed(orders_by_customer(spark, sf_dir, branched))
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    name = F.concat(F.lit("order"), F.lpad((F.col("k") + i % 2).cast("string"), 10, "0"))
    wanted = written(orders.select("doc_id", name.cast("binary").alias("key")), "wanted")
    found = bounded.looked_up(p.live, dests_root(p), wanted, bounded.NAMES)
    return found.select("doc_id", bounded.names(F.col("key")).alias("name"), navigation.text_value(F.col("value")).alias("value"))


# --- composite and Type 3 fonts: parts shown in codes of one to four bytes, and by drawn digits

CODES = {"letter": (2, 0x4000), "digit": (3, 0x810000), "other": (4, 0xE1000000)}


def code_of(c: str) -> bytes:
    """A space is one byte; letters, digits and others have two, three and four."""
    if c == " ":
        return b" "
    n, base = CODES["letter" if c.isalpha() else "digit" if c.isdigit() else "other"]
    return (base + ord(c)).to_bytes(n, "big")


PARENT_MAP = b"""1 begincodespacerange <E1000000> <E100FFFF> endcodespacerange
2 begincidrange <4000> <40FF> 1000 <E1000000> <E100FFFF> 4000 endcidrange 1 begincidchar <20> 1 endcidchar"""
MIDDLE_MAP = b"""/Base usecmap 3 begincodespacerange <20> <20> <4000> <40FF> <810000> <81FFFF> endcodespacerange
1 begincidrange <810000> <81FFFF> 3000 endcidrange"""
# The child puts its own id over one letter within the parent's range, and a wide range over all digits.
CHILD_MAP = b"/Middle usecmap /WMode %d def 1 begincidchar <4061> 9000 endcidchar 1 begincidrange <810000> <81FFFF> 10000 endcidrange"
TEXT_MAP = b"1 begincodespacerange <20> <20> endcodespacerange 4 beginbfrange <20> <20> <0020> <4000> <40FF> <0000> <810000> <8100FF> <0000> <E1000000> <E100FFFF> <0000> endbfrange"


def composed(doc_id: int, rows: list[dict]) -> bytes:
    """Names in a composite font whose map builds on two others; every second document writes downward."""
    tree, root, _ = page_tree(10, [b"/Contents %d 0 R /Resources 4 0 R" % (100 + i) for i in range(len(rows))])
    kid = {"Type": "/Font", "Subtype": "/CIDFontType2", "BaseFont": "/Own", "DW": 500, "W": [9000, [700]], "DW2": [800, -900], "W2": [9000, [-400, 350, 800]]}
    bodies = {
        1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 2: json_value({"Type": "/Font", "Subtype": "/Type0", "BaseFont": "/Own", "Encoding": "5 0 R", "ToUnicode": "8 0 R", "DescendantFonts": [kid]}),
        4: json_value({"Font": {"F1": "2 0 R"}}), 5: writer.stream(CHILD_MAP % (doc_id % 2), b"/Type /CMap /UseCMap 6 0 R"), 6: writer.stream(MIDDLE_MAP, b"/Type /CMap /UseCMap 7 0 R"),
        7: writer.stream(PARENT_MAP, b"/Type /CMap"), 8: writer.stream(TEXT_MAP),
    }
    for i, r in enumerate(rows):
        shown = b"".join(map(code_of, r["name"] or ""))
        bodies[100 + i] = writer.stream(b"BT /F1 10 Tf 100 700 Td <%s> Tj ET" % shown.hex().encode())
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


PART_ROWS = "WITH p AS (SELECT p_partkey // 8 AS doc_id, p_partkey AS k, coalesce(p_name, '') AS name, (row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1)::INTEGER AS i FROM part)"


def part_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 8 AS long)").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))


@query(PART_ROWS + """, n AS (SELECT *, length(name) AS n, length(name) - length(replace(name, 'a', '')) AS a FROM p)
    SELECT doc_id, i AS page_index, name AS text, CASE WHEN doc_id % 2 = 0 THEN (7 * a + 5 * (n - a))::DOUBLE ELSE 0.0 END AS across, CASE WHEN doc_id % 2 = 1 THEN (-4 * a - 9 * (n - a))::DOUBLE ELSE 0.0 END AS down,
    CASE WHEN doc_id % 2 = 0 THEN 100.0 WHEN name[1] = 'a' THEN 96.5 ELSE 97.5 END::DOUBLE AS x, CASE WHEN doc_id % 2 = 0 THEN 700.0 ELSE 692.0 END::DOUBLE AS y FROM n WHERE n > 0""")
def pdf_composite_text(spark, sf_dir):
    """Text and advances of composite fonts whose character map inherits from two others, across and downward."""
    runs = Parsed(writer.per_document(part_rows(spark, sf_dir), composed)).runs(kinds=("text",)).where("size(glyphs) > 0")

    def total(c: str):
        return F.round(F.aggregate("glyphs", F.lit(0.0), lambda acc, g: acc + g[c]), 6)

    said = F.array_join(F.transform("glyphs", lambda g: g["text"]), "")
    first = F.get("glyphs", F.lit(0))
    return runs.select("doc_id", "page_index", said.alias("text"), total("dx").alias("across"), total("dy").alias("down"), F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"))


DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def digit_drawn(doc_id: int, rows: list[dict]) -> bytes:
    """Part keys in a font whose digits are procedures; odd ones state a box, the nine nothing at all, so its listed width holds."""
    tree, root, _ = page_tree(10, [b"/Contents %d 0 R /Resources 4 0 R" % (100 + i) for i in range(len(rows))])
    procs = {f"{name}": f"{50 + d} 0 R" for d, name in enumerate(DIGITS)}
    font = {"Type": "/Font", "Subtype": "/Type3", "FontMatrix": [0.01, 0, 0, 0.01, 0, 0], "FontBBox": [0, 0, 100, 100], "CharProcs": "6 0 R", "FirstChar": 48, "LastChar": 57, "Widths": [33] * 10}
    font["Encoding"] = {"Differences": [48, *[f"/{name}" for name in DIGITS]]}
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 2: json_value(font), 4: json_value({"Font": {"T3": "2 0 R"}}), 6: json_value(procs)}
    for d in range(10):
        head = b"0 0 m 1 1 l S" if d == 9 else b"%d 0 %d 50 1 0 d1 0 0 5 5 re f" % (10 * d + 10, d) if d % 2 else b"%d 0 d0 0 0 5 5 re f" % (10 * d + 10)
        bodies[50 + d] = writer.stream(head)
    for i, r in enumerate(rows):
        bodies[100 + i] = writer.stream(b"BT /T3 20 Tf 10 10 Td (%d) Tj ET" % r["ord"])
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(PART_ROWS + """, d AS (SELECT doc_id, i, k, unnest(string_split(k::VARCHAR, ''))::INTEGER AS d FROM p)
    SELECT doc_id, i AS page_index, k::VARCHAR AS text, sum(CASE WHEN d = 9 THEN 33 ELSE 10 * d + 10 END * 0.2)::DOUBLE AS across FROM d GROUP BY doc_id, i, k""")
def pdf_type3_text(spark, sf_dir):
    """Part keys drawn by Type 3 procedures, advanced by the widths that the procedures state."""
    runs = Parsed(writer.per_document(part_rows(spark, sf_dir), digit_drawn)).runs(kinds=("text",))
    said = F.array_join(F.transform("glyphs", lambda g: g["text"]), "")
    return runs.select("doc_id", "page_index", said.alias("text"), F.round(F.aggregate("glyphs", F.lit(0.0), lambda acc, g: acc + g["dx"]), 6).alias("across"))


@query("""WITH n AS (SELECT DISTINCT p_partkey // 8 AS doc_id FROM part), d AS (SELECT unnest(range(10)) AS d, unnest(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine']) AS glyph)
    SELECT doc_id, glyph, CASE WHEN d < 9 THEN (10 * d + 10)::DOUBLE END AS width, CASE WHEN d % 2 = 1 AND d < 9 THEN '[' || least(d, 1) || ', 0, ' || greatest(d, 1) || ', 50]' END AS bbox FROM n, d""")
def pdf_type3_procedures(spark, sf_dir):
    """Widths and boxes of the glyph procedures of each document."""
    p = Parsed(writer.per_document(part_rows(spark, sf_dir), digit_drawn))
    box = F.concat(F.lit("["), F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ", "), F.lit("]"))
    return resources.char_procs(p.live, p.shared).select("doc_id", "glyph", "width", box.alias("bbox"))


# --- metadata packets: a title in two languages, creators, dates as elements or attributes

def described(doc_id: int, rows: list[dict]) -> bytes:
    title = html.escape(rows[0]["name"] or "none")
    creators = b"".join(b"<rdf:li>%s</rdf:li>" % html.escape(r["name"] or "none").encode() for r in rows)
    date = b"2020-%02d-11T10:20:30Z" % (doc_id % 12 + 1)
    attribute, element = (b' xmp:CreateDate="%s"' % date, b"") if doc_id % 2 else (b"", b"<xmp:CreateDate>%s</xmp:CreateDate>" % date)
    packet = (
        b'<?xpacket begin="\xef\xbb\xbf" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        b'<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"%s>'
        b'<dc:title><rdf:Alt><rdf:li xml:lang="x-default">%s</rdf:li><rdf:li xml:lang="fr">le %s</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq>%s</rdf:Seq></dc:creator>%s</rdf:Description>'
        b'<rdf:Description rdf:about="" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="pagequarry"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    ) % (attribute, title.encode(), title.encode(), creators, element)
    if doc_id % 5 == 4:
        packet = packet.replace(b"</rdf:RDF>", b"")  # malformed
    bodies = {1: b"<< /Type /Catalog /Metadata 5 0 R >>", 5: writer.stream(packet, b"/Type /Metadata /Subtype /XML", compress=bool(doc_id % 3))}
    return revision(b"", bodies, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(PART_ROWS + """, n AS (SELECT doc_id, i, CASE WHEN name = '' THEN 'none' ELSE name END AS name FROM p), g AS (SELECT doc_id, min_by(name, i) AS title, string_agg(name, '|' ORDER BY i) AS creators FROM n GROUP BY doc_id), o AS (SELECT *, doc_id % 5 <> 4 AS ok FROM g)
    SELECT doc_id, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN 'le ' || title END AS title_fr, CASE WHEN ok THEN creators END AS creators,
    CASE WHEN ok THEN '2020-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-11T10:20:30Z' END AS create_date, CASE WHEN ok THEN (doc_id % 12 + 1)::INTEGER END AS month, CASE WHEN ok THEN 'pagequarry' END AS producer, NOT ok AS malformed FROM o""")
def pdf_packets(spark, sf_dir):
    """Metadata packets: languages, creators in order, dates, what attributes state, and malformed ones."""
    p = Parsed(writer.per_document(part_rows(spark, sf_dir), described))
    m = navigation.metadata(navigation.packets(p.live, p.roots))
    return m.select(
        "doc_id", F.try_element_at("title", F.lit("x-default")).alias("title"), F.try_element_at("title", F.lit("fr")).alias("title_fr"), F.array_join("creators", "|").alias("creators"),
        "create_date", F.month("created").alias("month"), "producer", F.col("error").isNotNull().alias("malformed"),
    )


# --- layout: two columns of lines under a heading

def columned(doc_id: int, rows: list[dict]) -> bytes:
    """Four rows at the left, the others at the right, and a heading above; odd documents show the right column first."""
    font = b"/Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >> >> >>"
    tree, root, _ = page_tree(10, [b"/Contents 3 0 R"], font)
    left, right = rows[:4], rows[4:]
    columns = [(36, left), (330, right)]
    out = [b"BT /F1 8 Tf 1 0 0 1 36 780 Tm (heading %d) Tj" % doc_id]
    for x, own in columns[::-1] if doc_id % 2 else columns:
        for i, r in enumerate(own):
            out.append(b"1 0 0 1 %d %d Tm %s Tj" % (x, 700 - 10 * i, writer.escaped(b"part %d" % r["ord"])))
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: writer.stream(b"\n".join([*out, b"ET"]))}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(PART_ROWS + """, c AS (SELECT doc_id, CASE WHEN i < 4 THEN 1 ELSE 2 END AS box, string_agg('part ' || k, chr(10) ORDER BY i) AS text, count(*) AS n_lines FROM p GROUP BY ALL)
    SELECT doc_id, box::INTEGER AS box, n_lines, text FROM c UNION ALL SELECT DISTINCT doc_id, 0, 1, 'heading ' || doc_id FROM p""")
def pdf_columns(spark, sf_dir):
    """Boxes of a page in reading order: a heading, the left column and then the right one, whichever is painted first."""
    lines = written(boxes.line_rows(layout.glyph_boxes(Parsed(writer.per_document(part_rows(spark, sf_dir), columned)).runs(kinds=("text",)))), "lines")
    return boxes.text_boxes(lines).select("doc_id", F.col("box").cast("int").alias("box"), "n_lines", "text")
