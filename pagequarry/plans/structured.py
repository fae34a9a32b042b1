"""Queries over documents written from the relational tables: revisions, labels, outlines, fields, annotations, structure, forms."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagequarry.kernels import crypt
from pagequarry.operators import images, marked, navigation, resources, security, structure, tables, text
from pagequarry.plans.documents import Parsed
from pagequarry.plans.relational import table
from pagequarry.sources import writer
from pagequarry.sources.store import written
from pagequarry.sources.writer import json_value, page_tree, refs, revision, stream, text_string

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its DuckDB equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- revisions: a customer's orders as objects, changed and freed by a second revision

STYLES = ("table", "stream", "hybrid")


def revised(doc_id: int, rows: list[dict]) -> bytes:
    """Order keys as objects from 10 on; a second revision negates those of pending orders and frees those of finished ones."""
    style = STYLES[doc_id % 3]
    bodies = {1: b"<< /Type /Catalog /Version /1.%d >>" % (doc_id % 8), 2: stream(b"filler")}
    bodies |= {10 + i: b"%d" % r["ord"] for i, r in enumerate(rows)}
    data = revision(b"", bodies, b"/Root 1 0 R", style)
    changed = {10 + i: b"%d" % -r["ord"] for i, r in enumerate(rows) if r["status"] == "P"}
    freed = tuple(10 + i for i, r in enumerate(rows) if r["status"] == "F")
    if changed or freed:
        data = revision(data, changed, b"/Root 1 0 R", style, freed, writer.last_start(data), above=len(rows) + 15)
    return data.replace(b"startxref\n", b"startxref\n9") if doc_id % 5 == 0 else data


def order_documents(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return writer.per_document(orders, revised)


REVISED = "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus AS s, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 9)::INTEGER AS obj, o_custkey % 5 = 0 AS recovered FROM orders)"


@query(REVISED + " SELECT doc_id, obj, CASE WHEN s = 'P' AND NOT recovered THEN -o_orderkey ELSE o_orderkey END AS value, recovered FROM o WHERE recovered OR s <> 'F'")
def pdf_live_objects(spark, sf_dir):
    """Objects that the newest entries lead to; recovered documents keep first declarations."""
    p = Parsed(order_documents(spark, sf_dir))
    live = p.live.where("obj >= 10").select("doc_id", "obj", F.col("value").try_cast("long").alias("value")).where("value IS NOT NULL")
    return live.join(p.roots.select("doc_id", "recovered"), "doc_id")


@query(REVISED + " SELECT doc_id, obj, s = 'F' AS free FROM o WHERE NOT recovered")
def pdf_newest_entries(spark, sf_dir):
    """The newest entry of each order's object, over tables, streams and hybrid files."""
    holder = (F.col("kind") == "object") & tables.field("value", "Type").isin("/ObjStm", "/XRef")
    # both sides of the join come from one reading of the bytes
    read = tables.parts(order_documents(spark, sf_dir), kinds=("object", "entry")).where((F.col("kind") == "entry") | holder).drop("stream", "resolved", "error")
    found = written(read, "entries")
    newest = tables.newest_entries(found).where("obj >= 10")
    packed = found.where("kind = 'object'").select("doc_id", "obj")
    return newest.join(packed, ["doc_id", "obj"], "left_anti").select("doc_id", "obj", "free")


@query(REVISED + """ SELECT doc_id, count(DISTINCT obj) AS n, '1.' || (doc_id % 8) AS version, any_value(recovered) AS recovered,
    CASE WHEN any_value(recovered) THEN 0 ELSE (CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END) * (CASE WHEN bool_or(s IN ('F', 'P')) THEN 2 ELSE 1 END) END::BIGINT AS n_sections FROM o GROUP BY doc_id""")
def pdf_document_states(spark, sf_dir):
    """Version, recovery state and cross-reference sections of each document."""
    p = Parsed(order_documents(spark, sf_dir))
    plain = p.objects.where("obj >= 10").where(F.col("value").rlike("^-?[0-9]+$")).groupBy("doc_id").agg(F.countDistinct("obj").alias("n"))
    sections = tables.sections(p.parts).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"))
    joined = p.roots.select("doc_id", "version", "recovered").join(plain, "doc_id").join(sections, "doc_id", "left")
    return joined.select("doc_id", "n", "version", "recovered", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


# --- page labels: a page for each order of a customer, a range for each urgent one

LABEL_STYLES = ("D", "R", "r", "A", "a")


def labelled(doc_id: int, rows: list[dict]) -> bytes:
    ranges = [(i, {"S": "/" + LABEL_STYLES[r["ord"] % 5], "P": f"{doc_id}-", "St": i + 1}) for i, r in enumerate(rows) if r["priority"] == "1-URGENT"]
    nums = b" ".join(b"%d %s" % (i, json_value(v)) for i, v in ranges)
    tree, root, _ = page_tree(10, [b""] * len(rows))
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R /PageLabels 2 0 R >>" % root, 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Nums [%s] >>" % nums}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderpriority = '1-URGENT' AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    r AS (SELECT doc_id, CASE WHEN i = min(i) OVER (PARTITION BY doc_id) THEN 0 ELSE i END AS first, i + 1 AS start, ['D', 'R', 'r', 'A', 'a'][o_orderkey % 5 + 1] AS style FROM o WHERE u),
    l AS (SELECT o.doc_id, o.i, r.first, r.style, r.start + o.i - r.first AS n FROM o ASOF LEFT JOIN r ON o.doc_id = r.doc_id AND o.i >= r.first),
    s AS (SELECT *, concat(repeat('m', n // 1000), ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1],
        ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1], ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]) AS roman,
        CASE WHEN n <= 26 THEN chr((96 + n)::INTEGER) ELSE chr((96 + (n - 1) // 26)::INTEGER) || chr((97 + (n - 1) % 26)::INTEGER) END AS alpha FROM l)
    SELECT doc_id, i::INTEGER AS page_index, CASE WHEN first IS NULL THEN (i + 1)::VARCHAR ELSE doc_id || '-' || CASE style WHEN 'D' THEN n::VARCHAR WHEN 'R' THEN upper(roman) WHEN 'r' THEN roman
        WHEN 'A' THEN upper(alpha) ELSE alpha END END AS label FROM s""")
def pdf_page_labels(spark, sf_dir):
    """Labels of every page, read from each document's tree of label ranges."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("priority"))
    p = Parsed(writer.per_document(orders, labelled))
    return navigation.page_labels(p.live, p.roots, p.pages)


# --- outlines, destinations, actions and fields: customers of a nation, 200 a document

BUCKET = "(c_nationkey * 1000000 + c_custkey // 200)"


def customer_documents(spark, sf_dir, build) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("doc_id", F.expr("c_nationkey * 1000000 + cast(c_custkey div 200 AS long)"))
    rows = c.select("doc_id", F.struct("c_mktsegment", "c_custkey").alias("ord"), F.col("c_name").alias("name"), F.concat(F.lit("(tel) "), F.col("c_custkey").cast("string")).alias("phone"))
    return writer.per_document(rows, build)


def by_segment(rows: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r["ord"]["c_mktsegment"], []).append(r)
    return out


def outlined(doc_id: int, rows: list[dict]) -> bytes:
    """Segments hold customers; every third customer leads by an action, every third by a name, the others directly."""
    tree, root, pages = page_tree(10, [b""] * 3)
    at = max(tree) + 1
    segments = by_segment(rows)
    tops, bodies, names = [], {}, {}
    for segment, own in segments.items():
        top, at = at, at + 1
        kids = list(range(at, at + len(own)))
        at += len(own)
        tops.append((top, segment, kids))
        for i, (k, r) in enumerate(zip(kids, own, strict=True)):
            key = r["ord"]["c_custkey"]
            to = [f"{pages[key % 3]} 0 R", "/XYZ", key % 500, key % 700, 0]
            node = {"Title": r["name"], "Parent": f"{top} 0 R"}
            if i:
                node["Prev"] = f"{kids[i - 1]} 0 R"
            if i + 1 < len(kids):
                node["Next"] = f"{kids[i + 1]} 0 R"
            if key % 3 == 0:
                node["A"] = {"S": "/GoTo", "D": to}
            elif key % 3 == 1:
                node["Dest"] = f"to{key}"
                names[f"to{key}"] = to
            else:
                node["Dest"] = to
            bodies[k] = json_value(node)
    for i, (top, segment, kids) in enumerate(tops):
        node = {"Title": segment, "Parent": "2 0 R", "First": f"{kids[0]} 0 R", "Last": f"{kids[-1]} 0 R"}
        if i:
            node["Prev"] = f"{tops[i - 1][0]} 0 R"
        if i + 1 < len(tops):
            node["Next"] = f"{tops[i + 1][0]} 0 R"
        bodies[top] = json_value(node)
    pairs = [x for name in sorted(names) for x in (name, {"D": names[name]})]
    bodies |= {
        1: b"<< /Type /Catalog /Pages %d 0 R /Outlines 2 0 R /Names << /Dests 3 0 R >> >>" % root,
        2: b"<< /Type /Outlines /First %d 0 R /Last %d 0 R >>" % (tops[0][0], tops[-1][0]), 3: json_value({"Kids": ["4 0 R"]}), 4: json_value({"Names": pairs}),
    }
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


OUTLINE = f"""WITH c AS (SELECT {BUCKET} AS doc_id, c_custkey, c_name, c_mktsegment FROM customer),
    t AS (SELECT DISTINCT doc_id, c_mktsegment AS seg, -1 AS key, c_mktsegment AS title, 0 AS depth FROM c UNION ALL SELECT doc_id, c_mktsegment, c_custkey, c_name, 1 FROM c)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, key))::INTEGER AS place, depth, title"""


@query(OUTLINE + """, CASE WHEN depth = 0 THEN title ELSE seg || ' / ' || title END AS path, CASE WHEN depth = 1 THEN (key % 3)::INTEGER END AS page_index,
    CASE WHEN depth = 1 THEN (key % 500)::DOUBLE END AS x, CASE WHEN depth = 1 THEN (842 - key % 700)::DOUBLE END AS y FROM t""")
def pdf_outlines(spark, sf_dir):
    """Outline items in depth-first order with the page and place that they lead to, in screen space."""
    p = Parsed(customer_documents(spark, sf_dir, outlined))
    nodes = navigation.outline(p.live, p.roots)
    named = navigation.destinations(p.live, p.roots)
    targets = navigation.resolved_targets(nodes, p.live, named, p.pages)
    placed = navigation.target_positions(targets, p.pages, "screen")
    return placed.select("doc_id", "place", "depth", "title", "path", "page_index", F.get("pos", F.lit(0)).alias("x"), F.get("pos", F.lit(1)).alias("y"))


def with_fields(doc_id: int, rows: list[dict]) -> bytes:
    """A field for each segment, which gives its kind and flags to its customers unless they have their own."""
    at, bodies, tops = 10, {}, []
    for segment, own in by_segment(rows).items():
        top, at = at, at + 1
        kids = list(range(at, at + len(own)))
        at += len(own)
        tops.append(top)
        bodies[top] = json_value({"T": segment, "FT": "/Tx", "Ff": len(segment), "Kids": [f"{k} 0 R" for k in kids]})
        for k, r in zip(kids, own, strict=True):
            field = {"T": r["name"], "V": r["phone"], "Parent": f"{top} 0 R"}
            if r["ord"]["c_custkey"] % 3 == 0:
                field |= {"FT": "/Ch", "Opt": [["a", r["phone"]], "b"]} | ({"I": [1]} if r["ord"]["c_custkey"] % 2 else {})
            bodies[k] = json_value(field)
    bodies |= {1: b"<< /Type /Catalog /AcroForm 2 0 R >>", 2: b"<< /NeedAppearances %s /Fields %s >>" % (b"true" if doc_id % 2 else b"false", refs(tops))}
    return revision(b"", bodies, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(f"""WITH c AS (SELECT {BUCKET} AS doc_id, * FROM customer)
    SELECT doc_id, c_mktsegment || '.' || c_name AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'Ch' ELSE 'Tx' END AS field_type, length(c_mktsegment)::INTEGER AS flags, '(tel) ' || c_custkey AS value,
    CASE WHEN c_custkey % 3 = 0 THEN '(tel) ' || c_custkey || '|b' END AS options, doc_id % 2 = 1 AS need_appearances FROM c
    UNION ALL SELECT DISTINCT doc_id, c_mktsegment, 'Tx', length(c_mktsegment)::INTEGER, NULL, NULL, doc_id % 2 = 1 FROM c""")
def pdf_form_fields(spark, sf_dir):
    """Fields with full names, inherited kinds and flags, values and options."""
    p = Parsed(customer_documents(spark, sf_dir, with_fields))
    found = navigation.form_fields(p.live, p.roots).join(navigation.form_state(p.live, p.roots), "doc_id")
    return found.select("doc_id", "full_name", "field_type", "flags", "value", F.array_join("options", "|").alias("options"), "need_appearances")


@query(f"""SELECT {BUCKET} AS doc_id, c_mktsegment || '.' || c_name AS full_name, CASE WHEN c_custkey % 2 = 1 THEN 'b' ELSE '(tel) ' || c_custkey END AS picked,
    'a|b' AS exported FROM customer WHERE c_custkey % 3 = 0""")
def pdf_field_selections(spark, sf_dir):
    """Selected options of choice fields: as stated, else those that are the field's value."""
    p = Parsed(customer_documents(spark, sf_dir, with_fields))
    found = navigation.form_fields(p.live, p.roots).where("options IS NOT NULL")
    picked = F.array_join(F.transform("selected", lambda i: F.get("options", i)), "|")
    return found.select("doc_id", "full_name", picked.alias("picked"), F.array_join("option_values", "|").alias("exported"))


# --- annotations: an order's lines on one page

def annotated(doc_id: int, rows: list[dict]) -> bytes:
    notes = []
    for r in rows:
        box = [r["ord"], r["quantity"], r["ord"] + 10, r["quantity"] + 5]
        note = {"Subtype": "/Link", "Rect": box, "A": {"S": "/URI", "URI": f"http://part/{r['part']}"}, "F": r["ord"]}
        if r["flag"] == "N":
            note = {"Subtype": "/Text", "Rect": box, "Contents": f"é {r['comment']}", "C": [1, 0, 0]}
        if r["flag"] == "A":
            note = {"Subtype": "/Highlight", "QuadPoints": [0] * (8 if r["ord"] % 2 else 7), "Rect": box}
        notes.append(note)
    tree, root, pages = page_tree(10, [b"/Annots 2 0 R"])
    first = max(tree) + 1
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 2: refs(range(first, first + len(notes)))} | {first + i: json_value(n) for i, n in enumerate(notes)}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query("""SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity)::INTEGER, l_partkey, l_returnflag, l_linestatus) - 1)::INTEGER AS seq,
    CASE l_returnflag WHEN 'R' THEN 'Link' WHEN 'N' THEN 'Text' ELSE 'Highlight' END AS subtype, CASE WHEN l_returnflag = 'R' THEN 'http://part/' || l_partkey END AS uri,
    CASE WHEN l_returnflag = 'N' THEN 'é ' || l_linestatus END AS contents, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END::INTEGER AS flags,
    CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'QuadPoints' END AS error, (l_linenumber + 10)::DOUBLE AS x1 FROM lineitem""")
def pdf_annotations(spark, sf_dir):
    """Annotations in order; a malformed one says what is wrong."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("comment"),
    )
    p = Parsed(writer.per_document(lines, annotated))
    found = navigation.annotations(p.live, p.pages)
    return found.select("doc_id", "seq", "subtype", "uri", "contents", "flags", "error", F.get("rect", F.lit(2)).alias("x1"))


# --- structure: a conversation's turns as elements of a tagged page

ROLES = {"user": "Question", "assistant": "Answer", "system": "Note"}


def structured(doc_id: int, rows: list[dict]) -> bytes:
    """Turns in reverse order on the page, in order in the structure; those of the system carry their text in the tree alone."""
    sections = [(ROLES.get(r["role"], "P"), r["text"] or "") for r in rows]
    out = [b"BT /F1 10 Tf 36 800 Td"]
    for i, (tag, value) in reversed(list(enumerate(sections))):
        out.append(b"/%s << /MCID %d >> BDC 0 -12 Td %s Tj EMC" % (tag.encode(), i, writer.escaped(value.encode("cp1252", "replace"))))
    tree, root, pages = page_tree(10, [b"/Contents 3 0 R /StructParents 0"], b"/Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >> >>")
    first = max(tree) + 1
    bodies = {
        1: b"<< /Type /Catalog /Pages %d 0 R /StructTreeRoot 2 0 R /MarkInfo << /Marked true >> >>" % root,
        2: json_value({"K": "4 0 R", "RoleMap": {"Question": "/P", "Answer": "/BlockQuote"}, "ParentTree": "5 0 R"}), 3: stream(b"\n".join([*out, b"ET"])),
        4: json_value({"S": "/Document", "P": "2 0 R", "Pg": f"{pages[0]} 0 R", "K": [f"{first + i} 0 R" for i in range(len(rows))]}),
        5: json_value({"Nums": [0, [f"{first + i} 0 R" for i in range(len(rows))]]}),
    }
    for i, ((tag, _), r) in enumerate(zip(sections, rows, strict=True)):
        element = {"S": f"/{tag}", "P": "4 0 R", "K": i}
        if r["role"] == "system":
            element |= {"ActualText": f"note {i}", "A": [{"O": "/List"}, {"O": "/Layout", "BBox": [1, 2, i + 3, 4.5]}]}
        bodies[first + i] = json_value(element)
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


def conversation_documents(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", "text")
    return writer.per_document(turns, structured)


TURNS = "WITH t AS (SELECT conv_id AS doc_id, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS i FROM conversations)"


@query(TURNS + """ SELECT doc_id, i AS dfs_index, CASE role WHEN 'user' THEN 'P' WHEN 'assistant' THEN 'BlockQuote' WHEN 'system' THEN 'Note' ELSE 'P' END AS role,
    CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'Answer' WHEN 'system' THEN 'Note' ELSE 'P' END AS raw_role,
    CASE WHEN role = 'system' THEN 'note ' || (i - 1) ELSE coalesce(text, '') END AS text, i - 1 AS mcid FROM t
    UNION ALL SELECT DISTINCT conv_id, 0, 'Document', 'Document', '', NULL FROM conversations""")
def pdf_structure_text(spark, sf_dir):
    """Structure elements with standard roles, the text of their contents, and their slot in the page's parent tree."""
    p = Parsed(conversation_documents(spark, sf_dir))
    elems = structure.elements(p.live, p.roots)
    said = structure.element_text(elems, structure.contents(p.live, elems), p.pages, p.runs())
    slots = structure.parent_slots(p.live, p.roots, p.pages).select("doc_id", "node", "mcid")
    return elems.join(said, ["doc_id", "node"]).join(slots, ["doc_id", "node"], "left").select("doc_id", F.col("dfs_index").cast("int").alias("dfs_index"), "role", "raw_role", "text", "mcid")


@query(TURNS + """, n AS (SELECT *, max(i) OVER (PARTITION BY doc_id) - i AS back FROM t)
    SELECT doc_id, i AS dfs_index, CASE WHEN role = 'system' THEN 1.0 ELSE 36.0 END::DOUBLE AS x0, CASE WHEN role = 'system' THEN 2.0 ELSE 800.0 - 12 * (back + 1) END::DOUBLE AS y0,
    CASE WHEN role = 'system' THEN 4.5 ELSE 810.0 - 12 * (back + 1) END::DOUBLE AS y1 FROM n WHERE role = 'system' OR coalesce(text, '') <> ''""")
def pdf_element_boxes(spark, sf_dir):
    """Boxes of structure elements: stated by an attribute, or around what their marked content shows."""
    p = Parsed(conversation_documents(spark, sf_dir))
    elems = structure.elements(p.live, p.roots)
    found = structure.boxes(p.live, elems, structure.contents(p.live, elems), p.pages, p.runs())
    x = [F.round(F.get("bbox", F.lit(k)), 6) for k in range(4)]
    return found.join(elems.select("doc_id", "node", "dfs_index"), ["doc_id", "node"]).select("doc_id", F.col("dfs_index").cast("int").alias("dfs_index"), x[0].alias("x0"), x[1].alias("y0"), x[3].alias("y1"))


@query(TURNS + """ SELECT doc_id, trim(regexp_replace(string_agg(CASE WHEN role = 'system' THEN 'note ' || (i - 1) ELSE coalesce(text, '') END, '' ORDER BY i), '\\s+', ' ', 'g')) AS words FROM t GROUP BY doc_id""")
def pdf_logical_text(spark, sf_dir):
    """Tagged text in the order of the structure, with the structure's ActualText; every section lies above the one before, so none begins a line."""
    p = Parsed(conversation_documents(spark, sf_dir))
    elems = structure.elements(p.live, p.roots)
    content = structure.contents(p.live, elems)
    ranks = structure.logical_ranks(content, elems, p.pages)
    found = text.extract_text(p.runs(kinds=("text",)), p.roots.where("tagged"), "page", ranks, structure.actual_texts(content, elems, p.pages))
    return found.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("words"))


@query(TURNS + """, n AS (SELECT *, max(i) OVER (PARTITION BY doc_id) - i AS back FROM t)
    SELECT doc_id, 1 AS depth, CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'Answer' WHEN 'system' THEN 'Note' ELSE 'P' END AS tag, (i - 1)::INTEGER AS mcid,
    (3 + 4 * back)::INTEGER AS "begin", (6 + 4 * back)::INTEGER AS "end", 1::BIGINT AS n_shown FROM n""")
def pdf_marked_sections(spark, sf_dir):
    """Marked content as intervals of operations, with the text operations inside each."""
    p = Parsed(conversation_documents(spark, sf_dir))
    ops = written(tables.operations(p.content), "operations")
    found = written(marked.sections(ops, p.resources), "marked")
    shown = marked.inside(ops.where("operator = 'Tj'").select("doc_id", "page_index", "seq"), found).groupBy("doc_id", "page_index", "begin").agg(F.count(F.lit(1)).alias("n_shown"))
    return found.join(shown, ["doc_id", "page_index", "begin"], "left").select("doc_id", "depth", "tag", "mcid", "begin", "end", F.coalesce("n_shown", F.lit(0)).alias("n_shown"))


@query(TURNS + " SELECT doc_id, (i - 1)::INTEGER AS mcid, (max(i) OVER (PARTITION BY doc_id) - i + 1)::BIGINT AS place, 1::BIGINT AS n FROM t")
def pdf_content_sequence(spark, sf_dir):
    """Content ids of each page in the order of their runs."""
    p = Parsed(conversation_documents(spark, sf_dir))
    return marked.sequence(p.runs()).select("doc_id", "mcid", "place", "n")


# --- forms: parts shown by nested forms

def formed(doc_id: int, rows: list[dict]) -> bytes:
    """Each part by a form that shows its name and holds another one for its brand, moved and doubled in size."""
    font = {"Font": {"F1": {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica", "Encoding": "/WinAnsiEncoding"}}}
    tree, root, _ = page_tree(10, [b"/Contents 3 0 R /Resources 4 0 R"])
    at, bodies, names, page = max(tree) + 1, {}, {}, []
    for i, r in enumerate(rows):
        outer, inner = at + 2 * i, at + 2 * i + 1
        names[f"Fm{i}"] = f"{outer} 0 R"
        page.append(b"q 1 0 0 1 %d %d cm /Fm%d Do Q" % (10 * i, 20 * i, i))
        shown = b"BT /F1 10 Tf 1 2 Td %s Tj ET /In Do /Self Do" % writer.escaped((r["name"] or "").encode("cp1252", "replace"))
        own = font | {"XObject": {"In": f"{inner} 0 R", "Self": f"{outer} 0 R"}}
        bodies[outer] = stream(shown, b"/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Resources " + json_value(own))
        brand = b"BT /F1 5 Tf %s Tj ET" % writer.escaped((r["brand"] or "").encode("cp1252", "replace"))
        bodies[inner] = stream(brand, b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [2 0 0 2 3 4]")
    bodies |= {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: stream(b"\n".join(page)), 4: json_value({"XObject": names})}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


def part_table(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.expr("cast(p_partkey div 8 AS long)").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


def part_documents(spark, sf_dir) -> DataFrame:
    return writer.per_document(part_table(spark, sf_dir), formed)


PARTS = "WITH p AS (SELECT p_partkey // 8 AS doc_id, p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS i FROM part)"


@query(PARTS + """ SELECT doc_id, (2 * i)::INTEGER AS place, coalesce(p_name, '') AS text, (10 * i + 1)::DOUBLE AS x, (20 * i + 2)::DOUBLE AS y, 10.0::DOUBLE AS size FROM p
    UNION ALL SELECT doc_id, (2 * i + 1)::INTEGER, coalesce(p_brand, ''), (10 * i + 3)::DOUBLE, (20 * i + 4)::DOUBLE, 10.0::DOUBLE FROM p""")
def pdf_flattened_forms(spark, sf_dir):
    """Text of nested forms, expanded in place; a form that names itself is not entered again."""
    runs = Parsed(part_documents(spark, sf_dir)).runs(flatten=True).where("kind = 'text'")
    place = F.row_number().over(text.page_order("seq")) - 1
    said = F.array_join(F.transform("glyphs", lambda g: g["text"]), "")
    return runs.select("doc_id", place.alias("place"), said.alias("text"), "x", "y", "size")


@query(PARTS + """ SELECT doc_id, i::INTEGER AS part, 'outer' AS form, coalesce(p_name, '') AS text, 10.0::DOUBLE AS size, 1.0::DOUBLE AS x, 'In,Self' AS opaque FROM p
    UNION ALL SELECT doc_id, i::INTEGER, 'inner', coalesce(p_brand, ''), 5.0::DOUBLE, 0.0::DOUBLE, NULL FROM p""")
def pdf_form_views(spark, sf_dir):
    """Forms as views of their own: each form's text in its own space, and the forms that it names but does not enter."""
    runs = Parsed(part_documents(spark, sf_dir)).form_runs()
    said = F.array_join(F.transform("glyphs", lambda g: g["text"]), "")
    first = F.min("scope").over(Window.partitionBy("doc_id"))
    own = runs.select("doc_id", (F.col("scope") - first).alias("k"), "kind", "name", said.alias("said"), "size", "x", "seq")
    texts = own.where("kind = 'text'").select("doc_id", "k", F.col("said").alias("text"), "size", "x")
    named = own.where("kind = 'xobject'").groupBy("doc_id", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ",").alias("opaque"))
    form = F.when(F.col("k") % 2 == 0, "outer").otherwise("inner").alias("form")
    return texts.join(named, ["doc_id", "k"], "left").select("doc_id", F.expr("cast(k div 2 AS int)").alias("part"), form, "text", "size", "x", "opaque")


@query(PARTS + """ SELECT doc_id, 0 AS scope, 'Fm' || i AS name, 'page' AS held_by, [0.0, 0.0, 100.0, 100.0]::VARCHAR AS bbox FROM p
    UNION ALL SELECT doc_id, 1, 'In', 'form', [0.0, 0.0, 9.0, 9.0]::VARCHAR FROM p, range(2) UNION ALL SELECT doc_id, 1, 'Self', 'form', [0.0, 0.0, 100.0, 100.0]::VARCHAR FROM p, range(2)""")
def pdf_form_resources(spark, sf_dir):
    """Forms of every scope, those inside forms included; the inner form has no resources and uses its holder's."""
    found = resources.forms(Parsed(part_documents(spark, sf_dir)).resources)
    inside = F.col("scope") > 0
    return found.select(
        "doc_id", inside.cast("int").alias("scope"), "name", F.when(inside, "form").otherwise("page").alias("held_by"),
        F.concat(F.lit("["), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit("]")).alias("bbox"),
    )


@query(PARTS + """ SELECT doc_id, (strlen(string_agg('BT /F1 5 Tf (' || replace(replace(replace(coalesce(p_brand, ''), chr(92), repeat(chr(92), 2)), '(', chr(92) || '('), ')', chr(92) || ')') || ') Tj ET', '' ORDER BY i)))::BIGINT AS n_bytes, count(*) AS n,
    sha256(string_agg(sha256('BT /F1 5 Tf (' || replace(replace(replace(coalesce(p_brand, ''), chr(92), repeat(chr(92), 2)), '(', chr(92) || '('), ')', chr(92) || ')') || ') Tj ET'), '' ORDER BY i)) AS digest FROM p GROUP BY doc_id""")
def pdf_stream_digests(spark, sf_dir):
    """Length and digest of the decoded streams of each document's inner forms."""
    p = Parsed(part_documents(spark, sf_dir))
    inner = p.live.where(tables.field("value", "Matrix").isNotNull()).select("doc_id", "obj")
    found = images.stream_digests(p.live).join(inner, ["doc_id", "obj"], "left_semi")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("obj", "digest"))), lambda x: x["digest"])
    return found.groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("digest"))


# --- damage: parts on pages of two streams each

def damaged(doc_id: int, rows: list[dict]) -> bytes:
    """A page a part, name and brand in a stream each. By doc_id: sound; a string left open at the end of each first stream;
    a catalog without pages; no readable sections, and a comment that looks like the first stream's object."""
    how = doc_id % 4
    first = 10 + len(rows) + len(rows) // 7 + 20
    contents = [b"/Contents [%d 0 R %d 0 R] /Resources 4 0 R" % (first + 2 * i, first + 2 * i + 1) for i in range(len(rows))]
    tree, root, _ = page_tree(10, contents)
    bodies = {1: b"<< /Type /Catalog >>" if how == 2 else b"<< /Type /Catalog /Pages %d 0 R >>" % root}
    bodies[4] = json_value({"Font": {"F1": {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica", "Encoding": "/WinAnsiEncoding"}}})
    for i, r in enumerate(rows):
        for k, (y, value) in enumerate(((800, r["name"]), (780, r["brand"]))):
            shown = b"BT /F1 10 Tf 36 %d Td %s Tj ET" % (y, writer.escaped((value or "").encode("cp1252", "replace")))
            bodies[first + 2 * i + k] = stream(shown + (b" (left open" if how == 1 and k == 0 else b""))
    data = revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id // 4 % 3])
    ghost = b"%%PDF-1.7\n%% %d 0 obj (ghost) endobj\n" % first
    return data.replace(b"%PDF-1.7\n", ghost, 1) if how == 3 else data


@query(PARTS + """ SELECT doc_id, i::INTEGER AS page_index, coalesce(p_name, '') || chr(10) || coalesce(p_brand, '') AS text, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS n_errors, doc_id % 4 = 3 AS recovered FROM p""")
def pdf_damaged_pages(spark, sf_dir):
    """Damaged documents: an open string ends its stream alone and is told, pages are found without a tree, comments hold no objects."""
    p = part_table(spark, sf_dir)
    found = Parsed(writer.per_document(p, damaged))
    runs = written(found.runs(kinds=("text",)), "runs")
    errors = runs.where("kind = 'error'").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    told = text.untagged_text(runs).join(errors, ["doc_id", "page_index"], "left").join(found.roots.select("doc_id", "recovered"), "doc_id")
    return told.select("doc_id", "page_index", "text", F.coalesce("n", F.lit(0)).alias("n_errors"), "recovered")


# --- selections and graphics state: suppliers as filled boxes

def drawn(doc_id: int, rows: list[dict]) -> bytes:
    page, states = [], {}
    for i, r in enumerate(rows):
        k = r["ord"]
        states[f"GS{i}"] = {"LW": k % 7 + 0.5, "ca": (k % 4) / 4}
        color = (b"/Cs1 cs %d 2 scn" % (k % 3), b"%g g" % (k % 4 / 4), b"1 0 %g rg" % (k % 2))[k % 3]
        page.append(b"q /GS%d gs %s %d %d 10 5 re %s Q" % (i, color, 10 * i, k % 100, (b"f", b"B", b"S")[k % 3]))
    tree, root, _ = page_tree(10, [b"/Contents [3 0 R 5 0 R] /Resources 4 0 R"])
    half = len(page) // 2
    bodies = {
        1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: stream(b"\n".join(page[:half])), 5: stream(b"\n".join(page[half:])), 6: b"[/Separation /Spot /DeviceRGB 7 0 R]",
        4: json_value({"ExtGState": states, "ColorSpace": {"Cs1": "6 0 R"}}),
    }
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


def supplier_documents(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.expr("cast(s_suppkey div 4 AS long)").alias("doc_id"), F.col("s_suppkey").alias("ord"))
    return writer.per_document(s, drawn)


SUPPLIERS = "WITH s AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey AS k, row_number() OVER (PARTITION BY s_suppkey // 4 ORDER BY s_suppkey) - 1 AS i FROM supplier)"


@query(SUPPLIERS + """ SELECT doc_id, i::INTEGER AS place, (k % 7 + 0.5)::DOUBLE AS width, ((k % 4) / 4)::DOUBLE AS alpha, ['Cs1', 'DeviceGray', 'DeviceRGB'][k % 3 + 1] AS space,
    CASE k % 3 WHEN 0 THEN (k % 3)::DOUBLE WHEN 1 THEN (k % 4 / 4)::DOUBLE ELSE 1 END AS first, (10 * i)::DOUBLE AS x0, (k % 100 + 5)::DOUBLE AS y1, k % 3 <> 2 AS fill, k % 3 <> 0 AS stroke FROM s""")
def pdf_graphics_state(spark, sf_dir):
    """Painted boxes with the colours, line width and alpha that are in force."""
    paths = Parsed(supplier_documents(spark, sf_dir)).runs().where("kind = 'path'")
    c = F.col("fill_color")
    return paths.select(
        "doc_id", (F.row_number().over(text.page_order("seq")) - 1).alias("place"), F.col("line.width").alias("width"), F.col("fill_alpha").alias("alpha"),
        c["space"].alias("space"), F.get(c["values"], F.lit(0)).alias("first"), F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1"), "fill", "stroke",
    )


@query(SUPPLIERS + """ SELECT doc_id, 'gs' AS operator, 'ExtGState' AS category, 'GS' || i AS name, (k % 7 + 0.5)::DOUBLE AS width, true AS known FROM s
    UNION ALL SELECT doc_id, 'cs', 'ColorSpace', 'Cs1', NULL, true FROM s WHERE k % 3 = 0""")
def pdf_selections(spark, sf_dir):
    """Operations that select resources, with what they select."""
    p = Parsed(supplier_documents(spark, sf_dir))
    found = resources.selections(tables.operations(p.content), p.resources)
    return found.select("doc_id", "operator", "category", "name", tables.field("value", "LW").try_cast("double").alias("width"), "known")


@query(SUPPLIERS + " SELECT doc_id, i::INTEGER AS i, 'B' AS name, (10 * i)::DOUBLE AS x0 FROM s WHERE k % 3 = 1")
def pdf_restricted_operators(spark, sf_dir):
    """Paths that one operator paints; the fold makes no row of any other."""
    paths = Parsed(supplier_documents(spark, sf_dir)).runs(kinds=("path",), operators=("B",))
    x = F.get("bbox", F.lit(0))
    return paths.select("doc_id", (x / 10).cast("int").alias("i"), "name", x.alias("x0"))


def overprinted(doc_id: int, rows: list[dict]) -> bytes:
    """Boxes under states with masks, overprint, knockout and halftones; what a state does not name stays as it was."""
    page, states = [], {}
    for i, r in enumerate(rows):
        k = r["ord"]
        state = {"OPM": k % 2, "AIS": k % 2 == 0, "SMask": ({"S": "/Luminosity", "G": "9 0 R"}, "/None", {"S": "/Alpha"})[k % 3], "BM": ["/Multiply", "/Screen"]}
        state |= ({"OP": True}, {"OP": True, "op": False}, {"TK": False, "HT": {"HalftoneType": 5}})[k % 3]
        states[f"GS{i}"] = state
        page.append(b"q /GS%d gs %d 0 10 5 re f Q" % (i, 10 * i))
    tree, root, _ = page_tree(10, [b"/Contents 3 0 R /Resources 4 0 R"])
    bodies = {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 3: stream(b"\n".join(page)), 4: json_value({"ExtGState": states})}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


@query(SUPPLIERS + """ SELECT doc_id, i::INTEGER AS place, ['Luminosity', NULL, 'Alpha'][k % 3 + 1] AS soft_mask, k % 2 = 0 AS alpha_is_shape, k % 3 <> 2 AS knockout, k % 3 <> 2 AS overprint_stroke,
    k % 3 = 0 AS overprint_fill, (k % 2)::INTEGER AS overprint_mode, CASE WHEN k % 3 = 2 THEN 'Type5' END AS halftone, 'Multiply' AS blend FROM s""")
def pdf_effects(spark, sf_dir):
    """Masks, overprint, knockout and halftones in force where boxes are painted."""
    docs = table(spark, sf_dir, "supplier").select(F.expr("cast(s_suppkey div 4 AS long)").alias("doc_id"), F.col("s_suppkey").alias("ord"))
    paths = Parsed(writer.per_document(docs, overprinted)).runs(kinds=("path",))
    return paths.select("doc_id", (F.row_number().over(text.page_order("seq")) - 1).alias("place"), "effects.*", "blend")


# --- encryption: parts as strings and streams, three methods

PERMISSIONS, OWNER = (-1, -5, -9, -17), b"o" * 32


def security_of(doc_id: int) -> tuple[dict, bytes, bytes]:
    """Encrypt dictionary, file id and key of a document whose user password is ``open``."""
    revision_of = doc_id % 3 + 2
    file_id = hashlib.md5(b"%d" % doc_id).digest()
    length = 40 if revision_of == 2 else 128
    p = PERMISSIONS[doc_id % 4]
    key = crypt.file_key(b"open", OWNER, p, file_id, length // 8, revision_of)
    user = (crypt.user_entry(key, file_id, revision_of) + bytes(32))[:32]
    spec = {"Filter": "/Standard", "V": (1, 2, 4)[doc_id % 3], "R": revision_of, "Length": length, "P": p}
    if revision_of == 4:
        spec |= {"CF": {"StdCF": {"CFM": "/AESV2", "Length": 16}}, "StmF": "/StdCF", "StrF": "/StdCF"}
    return spec | {"O": OWNER, "U": user}, file_id, key


@F.pandas_udf(BinaryType())
def key_of(ids: pd.Series) -> pd.Series:
    return ids.map(lambda i: security_of(i)[2])


def sealed(doc_id: int, rows: list[dict]) -> bytes:
    """Each part's name as a string and its brand as a stream; ``name`` and ``brand`` are encrypted already where AES is used."""
    spec, file_id, key = security_of(doc_id)

    def cipher(data: bytes, obj: int) -> bytes:
        return bytes(data) if doc_id % 3 == 2 else crypt.rc4(hashlib.md5(key + obj.to_bytes(3, "little") + bytes(2)).digest()[: min(len(key) + 5, 16)], bytes(data))

    def hexed(data: bytes) -> bytes:
        return b"<" + data.hex().encode() + b">"

    bodies = {1: b"<< /Type /Catalog >>"}
    for i, r in enumerate(rows):
        bodies[10 + 2 * i] = b"<< /Name %s >>" % hexed(cipher(r["name"], 10 + 2 * i))
        bodies[11 + 2 * i] = stream(cipher(r["brand"], 11 + 2 * i), compress=False)
    pairs = [b"/%s %s" % (k.encode(), hexed(v) if isinstance(v, bytes) else json_value(v)) for k, v in spec.items()]
    bodies[2] = b"<< " + b" ".join(pairs) + b" >>"
    return revision(b"", bodies, b"/Root 1 0 R /Encrypt 2 0 R /ID [%s %s]" % (hexed(file_id), hexed(file_id)))


def sealed_documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 8 AS long)").alias("doc_id"), F.col("p_partkey").alias("ord"), "p_name", "p_brand")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    keyed = rows.withColumn("i", place).withColumn("key", key_of("doc_id"))

    def locked(column: str, first: int):
        obj = F.col("i") * 2 + first
        data = F.coalesce(column, F.lit("")).cast("binary")
        own = security.object_key(F.col("key"), obj, F.lit(0), F.lit("AESV2"))
        aes = F.aes_encrypt(data, F.when(F.octet_length(own) == 16, own), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.md5(F.concat(column, obj.cast("string")))))
        return F.when(F.col("doc_id") % 3 == 2, aes).otherwise(data)

    return writer.per_document(keyed.select("doc_id", "ord", locked("p_name", 10).alias("name"), locked("p_brand", 11).alias("brand")), sealed)


@query(PARTS + """ SELECT doc_id, (10 + 2 * i)::INTEGER AS obj, coalesce(p_name, '') AS text, doc_id % 4 <> 1 AS printable, doc_id % 4 <> 2 AS modifiable, doc_id % 4 <> 3 AS extractable FROM p
    UNION ALL SELECT doc_id, (11 + 2 * i)::INTEGER, coalesce(p_brand, ''), doc_id % 4 <> 1, doc_id % 4 <> 2, doc_id % 4 <> 3 FROM p""")
def pdf_decrypted(spark, sf_dir):
    """Strings and streams of encrypted documents, read with the user password, and what the documents allow."""
    p = Parsed(sealed_documents(spark, sf_dir))
    keys = written(security.unlocked(p.live, p.roots, "open"), "keys")
    found = security.decrypted(p.live, keys).where("obj >= 10")
    said = F.coalesce(F.col("stream").cast("string"), navigation.text_value(tables.field("value", "Name")))
    return found.select("doc_id", "obj", said.alias("text")).join(security.permissions(p.roots, keys), "doc_id")


@query("SELECT DISTINCT p_partkey // 8 AS doc_id, 'password required' AS missing, 'invalid password' AS wrong FROM part")
def pdf_password_errors(spark, sf_dir):
    """What opening an encrypted document says without a password and with a wrong one."""
    p = Parsed(sealed_documents(spark, sf_dir))
    missing, wrong = (security.unlocked(p.live, p.roots, x).select("doc_id", F.col("error").alias(name)) for x, name in ((None, "missing"), ("nope", "wrong")))
    return missing.join(wrong, "doc_id")


# --- keys of revisions 5 and 6: the same strings and streams, sealed by Spark's AES with a key that a user and an owner password open

def hex_of(data: bytes) -> bytes:
    return b"<" + bytes(data).hex().encode() + b">"


def strongly_sealed(doc_id: int, rows: list[dict]) -> bytes:
    """What was encrypted before, written out; even documents have revision 5, odd ones 6."""
    own = rows[0]
    spec = {"Filter": "/Standard", "V": 5, "R": 5 + doc_id % 2, "P": PERMISSIONS[doc_id % 4], "StmF": "/StdCF", "StrF": "/StdCF", "CF": {"StdCF": {"CFM": "/AESV3", "Length": 32}}}
    pairs = [b"/%s %s" % (k.encode(), json_value(v)) for k, v in spec.items()] + [b"/%s %s" % (k.encode(), hex_of(own[k.lower()])) for k in ("U", "UE", "O", "OE")]
    bodies = {1: b"<< /Type /Catalog >>", 2: b"<< " + b" ".join(pairs) + b" >>"}
    for i, r in enumerate(rows):
        bodies[10 + 2 * i] = b"<< /Name %s >>" % hex_of(r["name"])
        bodies[11 + 2 * i] = stream(bytes(r["brand"]), compress=False)
    return revision(b"", bodies, b"/Root 1 0 R /Encrypt 2 0 R")


def strongly_sealed_documents(spark, sf_dir) -> DataFrame:
    doc = F.expr("cast(p_partkey div 8 AS long)")
    rows = table(spark, sf_dir, "part").select(doc.alias("doc_id"), F.col("p_partkey").alias("ord"), "p_name", "p_brand")

    def drawn_bytes(what: str, n: int):
        return F.substring(F.unhex(F.sha2(F.concat(F.lit(what), F.col("doc_id").cast("string")).cast("binary"), 256)), 1, n)

    none, level = F.lit(b""), F.lit(5) + F.col("doc_id") % 2
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))  # numbers are few bytes and keys costly
    docs = rows.select("doc_id").repartition(slots, "doc_id").distinct().withColumn("key", drawn_bytes("key", 32))
    for name, word in (("u", b"open"), ("o", b"boss")):  # hash, validation salt, key salt; then the key under a hash of the password
        check, inner = drawn_bytes(name + "check", 8), drawn_bytes(name + "key", 8)
        after = none if name == "u" else F.col("u")
        docs = docs.withColumn(name, F.concat(security.hardened(F.lit(word), check, after, level), check, inner))
        docs = docs.withColumn(name + "e", security.aes_plain(F.col("key"), security.hardened(F.lit(word), inner, after, level), F.lit(bytes(16))))
    met = rows.join(written(docs, "strong-keys"), "doc_id")

    def locked(column: str):
        data = F.coalesce(column, F.lit("")).cast("binary")
        return F.aes_encrypt(data, F.col("key"), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.md5(F.concat(F.coalesce(column, F.lit("")), F.col("ord").cast("string")).cast("binary"))))

    return writer.per_document(met.select("doc_id", "ord", locked("p_name").alias("name"), locked("p_brand").alias("brand"), "u", "ue", "o", "oe"), strongly_sealed)


@query(PARTS + """, e AS (SELECT doc_id, i, unnest([p_name, p_brand]) AS t, unnest([0, 1]) AS k FROM p)
    SELECT doc_id, (10 + 2 * i + k)::INTEGER AS obj, coalesce(t, '') AS text, (5 + doc_id % 2)::INTEGER AS revision, 256 AS bits, 'AESV3' AS method, true AS same_by_owner, 'invalid password' AS wrong, doc_id % 4 <> 1 AS printable FROM e""")
def pdf_strong_keys(spark, sf_dir):
    """Documents of revisions 5 and 6: read by the user's password, the key found by the owner's as well, and a wrong one refused."""
    p = Parsed(strongly_sealed_documents(spark, sf_dir))
    keys = written(security.unlocked(p.live, p.roots, "open"), "keys")
    found = security.decrypted(p.live, keys).where("obj >= 10")
    said = F.coalesce(F.col("stream").cast("string"), navigation.text_value(tables.field("value", "Name")))
    owner = security.unlocked(p.live, p.roots, "boss").select("doc_id", F.col("key").alias("owner_key"))
    wrong = security.unlocked(p.live, p.roots, "nope").select("doc_id", F.col("error").alias("wrong"))
    told = keys.select("doc_id", "key").join(owner, "doc_id").join(wrong, "doc_id").select("doc_id", (F.col("key") == F.col("owner_key")).alias("same_by_owner"), "wrong")
    info = security.encryption_info(p.live, p.roots).select("doc_id", "revision", "bits", F.col("stream_method").alias("method"))
    allowed = security.permissions(p.roots, keys).select("doc_id", "printable")
    return found.select("doc_id", "obj", said.alias("text")).join(told, "doc_id").join(info, "doc_id").join(allowed, "doc_id")


# --- images: parts as small pictures of 1, 2, 4 and 8 bits, every fifth with a palette

def pictured(doc_id: int, rows: list[dict]) -> bytes:
    """Five samples a row, two rows; byte j of row r is (31 k + 17 r + 5 j) mod 256."""
    tree, root, _ = page_tree(10, [b"/Resources 4 0 R"])
    at, bodies, names = max(tree) + 1, {}, {}
    for i, r in enumerate(rows):
        k = r["ord"]
        bits = (1, 2, 4, 8)[k % 4]
        per_row = (5 * bits + 7) // 8
        data = bytes((31 * k + 17 * row + 5 * j) % 256 for row in range(2) for j in range(per_row))
        space = b"[/Indexed /DeviceRGB 2 <000000102030405060>]" if k % 5 == 0 else b"/DeviceGray"
        bodies[at + i] = stream(data, b"/Type /XObject /Subtype /Image /Width 5 /Height 2 /BitsPerComponent %d /ColorSpace %s" % (bits, space))
        names[f"Im{k}"] = f"{at + i} 0 R"
    bodies |= {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 4: json_value({"XObject": names})}
    return revision(b"", bodies | tree, b"/Root 1 0 R", STYLES[doc_id % 3])


def picture_documents(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return writer.per_document(p.select(F.expr("cast(p_partkey div 8 AS long)").alias("doc_id"), F.col("p_partkey").alias("ord")), pictured)


@query("""WITH k AS (SELECT p_partkey AS k, [1, 2, 4, 8][p_partkey % 4 + 1] AS b FROM part),
    v AS (SELECT k, b, [(((31 * k + 17 * (i // 5) + 5 * ((i % 5) * b // 8)) % 256)::INTEGER >> (8 - b - ((i % 5) * b) % 8)::INTEGER) & ((1 << b) - 1)::INTEGER for i in range(10)] AS s FROM k)
    SELECT k // 8 AS doc_id, 'Im' || k AS name, 5 AS width, 2 AS height, b AS bits, CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END AS components,
    array_to_string(list_transform(s, lambda x: CASE WHEN k % 5 <> 0 THEN printf('%02X', x::INTEGER) WHEN x = 1 THEN '102030' WHEN x = 2 THEN '405060' ELSE '000000' END), '') AS samples FROM v""")
def pdf_image_samples(spark, sf_dir):
    """Image resources with their samples unpacked and palettes expanded."""
    p = Parsed(picture_documents(spark, sf_dir))
    return images.decoded_images(p.live, p.resources).select("doc_id", "name", "width", "height", "bits", "components", F.hex("samples").alias("samples"))
