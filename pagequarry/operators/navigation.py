"""Outline, name trees, destinations, annotations and form fields from the objects relation.

All inputs are ``live`` objects (doc_id, obj, value) and ``roots`` (doc_id, catalog, trailer)
of :mod:`pagequarry.operators.tables`. Linked lists become positions by pointer
doubling (a join per doubling, not per item), trees become level joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import geometry, labels
from pagequarry.kernels import filters
from pagequarry.kernels.syntax import DOC_ENCODING
from pagequarry.operators import sequences, trees
from pagequarry.operators.tables import bare, expanded, field, page_matrix, ref
from pagequarry.sources.store import written


#: Characters of the Latin-1 reading of a string whose document encoding differs, and what they stand for.
_ODD = "".join(map(chr, DOC_ENCODING)), "".join(map(chr, DOC_ENCODING.values()))


def text_value(value: Column) -> Column:
    """Text of a string value by its mark, else in the document encoding; names lose their slash, other values give null."""
    digits = F.regexp_extract(value, "^s:([0-9a-f]*)$", 1)
    raw = F.unhex(digits)
    even = (F.length(digits) - 4) / 4  # UTF-16 units; an odd last byte is dropped
    return (
        F.when(value.startswith("s:feff"), F.decode(F.unhex(F.substring(digits, F.lit(5), (even.cast("int") * 4))), "UTF-16BE"))
        .when(value.startswith("s:efbbbf"), F.decode(F.unhex(F.substring(digits, 7, 2**30)), "UTF-8"))
        .when(value.startswith("s:"), F.translate(F.decode(raw, "ISO-8859-1"), *_ODD))
        .when(value.startswith("/"), F.substring(value, 2, 2**30))
    )


def numbers(value: Column) -> Column:
    return F.from_json(value, "array<double>")


def items(value: Column) -> Column:
    """Elements of a JSON array, each as JSON or bare string."""
    return F.from_json(value, "array<string>")


def resolved(rows: DataFrame, live: DataFrame, column: str) -> DataFrame:
    """``column`` with a reference replaced by its object's value."""
    found = live.select("doc_id", F.col("obj").alias("_obj"), bare(F.col("value")).alias("_value"))
    return (
        rows.withColumn("_obj", ref(F.col(column)))
        .join(found, ["doc_id", "_obj"], "left")
        .withColumn(column, F.coalesce("_value", column))
        .drop("_obj", "_value")
    )


def information(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and ``info``: the text of every string, name and number of the information dictionary."""
    found = resolved(roots.select("doc_id", field("trailer", "Info").alias("v")), live, "v")
    entries = F.map_entries(F.from_json("v", "map<string,string>"))
    told = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(text_value(e["value"]), F.when(e["value"].rlike(r"^-?[0-9.]+$"), e["value"])).alias("value")))
    return found.select("doc_id", F.map_from_entries(F.filter(told, lambda e: e["value"].isNotNull())).alias("info"))


def list_positions(links: DataFrame, rounds: int = 32) -> DataFrame:
    """doc_id, node and its place in a list of (doc_id, node, prev) links; members of a cycle have none."""
    state = links.select("doc_id", "node", F.col("prev").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("place"))
    for _ in range(rounds):
        state = written(state, "positions")
        if state.where("jump IS NOT NULL").isEmpty():
            break
        ahead = state.select("doc_id", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("place").alias("_place"))
        state = state.join(ahead, ["doc_id", "jump"], "left").select(
            "doc_id", "node", F.col("_jump").alias("jump"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")
        )
    return state.where("jump IS NULL").select("doc_id", "node", "place")


def outline(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, node, parent, depth, place (depth first), title, target (JSON of destination or action)."""
    tops = roots.select("doc_id", ref(field("catalog", "Outlines")).alias("top"))
    nodes = live.where(field("value", "Title").isNotNull()).select(
        "doc_id", F.col("obj").alias("node"), ref(field("value", "Parent")).alias("up"), ref(field("value", "Prev")).alias("prev"),
        text_value(field("value", "Title")).alias("name"), F.coalesce(field("value", "Dest"), field("value", "A", "D"), field("value", "A", "URI")).alias("target"),
    )
    nodes = written(nodes, "outline")
    placed = nodes.join(list_positions(nodes), ["doc_id", "node"]).join(tops, "doc_id")
    parent = F.when(F.col("up") != F.col("top"), F.col("up"))
    edges = placed.select("doc_id", "node", parent.alias("parent"), F.col("place").cast("long").alias("ord"), "name")
    reached = trees.walk(written(edges, "outline-edges"), ["doc_id"], sep=" / ")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    return reached.withColumn("place", order).join(nodes.select("doc_id", "node", F.col("name").alias("title"), "target"), ["doc_id", "node"]).select(
        "doc_id", "node", "parent", "depth", "place", "path", "title", "target"
    )


def name_tree(live: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, seq, name, value of the trees that begin at ``starts`` (doc_id, node)."""
    kids = live.select("doc_id", F.col("obj").alias("parent"), F.posexplode(items(field("value", "Kids"))).alias("ord", "kid"))
    edges = kids.select("doc_id", ref(F.col("kid")).alias("node"), "parent", F.col("ord").cast("long").alias("ord"), F.lit("").alias("name"))
    tops = starts.select("doc_id", "node", F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("name"))
    reached = trees.walk(written(edges.unionByName(tops), "name-tree"), ["doc_id"])
    named = reached.join(live.select("doc_id", F.col("obj").alias("node"), items(field("value", "Names")).alias("pairs")), ["doc_id", "node"])
    listed = named.select("doc_id", "order", "pairs", F.posexplode("pairs").alias("i", "key")).where("i % 2 = 0 AND i + 1 < size(pairs)")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "i")) - 1
    return listed.select("doc_id", seq.alias("seq"), text_value(F.col("key")).alias("name"), F.get("pairs", F.col("i") + 1).alias("value"))


def destinations(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, name, page_obj, view, params. The catalog's own dictionary wins over the name tree; of equal names the first holds."""
    own = resolved(roots.select("doc_id", field("catalog", "Dests").alias("d")), live, "d").where("d IS NOT NULL")
    direct = own.select("doc_id", F.lit(0).alias("seq"), F.explode(F.from_json("d", "map<string,string>")).alias("name", "value"))
    names = resolved(roots.join(own, "doc_id", "left_anti").select("doc_id", field("catalog", "Names").alias("n")), live, "n")
    tree = name_tree(live, names.select("doc_id", ref(field("n", "Dests")).alias("node")).where("node IS NOT NULL"))
    first = sequences.one_per(direct.unionByName(tree), ["doc_id", "name"], ["seq"])
    return destination_columns(resolved(first, live, "value"))


def destination_columns(rows: DataFrame) -> DataFrame:
    """Views with as many parameters as their kind needs; others stay null."""
    array = items(F.when(F.col("value").startswith("{"), field("value", "D")).otherwise(F.col("value")))
    need = F.create_map(*[F.lit(x) for pair in VIEW_PARAMETERS.items() for x in pair])
    view = F.get("array", F.lit(1))
    params = F.transform(F.slice("array", 3, 8), lambda x: x.try_cast("double"))
    found = rows.withColumn("array", array).withColumn("view", view).withColumn("params", F.when(F.size("array") >= 2, params))
    ok = need[F.col("view")] <= F.size("params")
    return found.select("doc_id", "name", "array", ref(F.get("array", F.lit(0))).alias("page_obj"), F.when(ok, F.substring("view", 2, 2**30)).alias("view"), F.when(ok, F.col("params")).alias("params"))


# Parameters that each destination view needs.
VIEW_PARAMETERS = {"/XYZ": 3, "/Fit": 0, "/FitB": 0, "/FitH": 1, "/FitV": 1, "/FitBH": 1, "/FitBV": 1, "/FitR": 4}


def annotations(live: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per annotation of each page; ``error`` names what a malformed one lacks."""
    lists, held = live.where(F.col("value").startswith("[")), live.where(F.col("value").startswith("{"))  # nothing else can be read as what is named
    listed = resolved(pages.select("doc_id", "page_index", field("value", "Annots").alias("a")).where("a IS NOT NULL"), lists, "a")
    each = resolved(listed.select("doc_id", "page_index", F.posexplode(items(F.col("a"))).alias("seq", "v")), held, "v")
    members = "Subtype", "Rect", "QuadPoints", "Contents", "M", "F", "C", "A"  # a value is read once, not for each of them
    each = written(each.select("doc_id", "page_index", "seq", F.json_tuple("v", *members).alias(*members)), "annotations")
    apart = ~F.col("A").startswith("{") & ref(F.col("A")).isNotNull()
    if not each.where(apart).isEmpty():  # actions mostly stand in their annotation: only the others are looked up
        each = each.where(~F.coalesce(apart, F.lit(False))).unionByName(resolved(each.where(apart), held, "A"))
    told = each.select("*", F.json_tuple("A", "S", "URI").alias("S", "URI"), numbers(F.col("Rect")).alias("rect_"), numbers(F.col("QuadPoints")).alias("quads"), numbers(F.col("C")).alias("color_"))
    rect, quads, color = F.col("rect_"), F.col("quads"), F.col("color_")
    error = F.when(~F.coalesce(F.col("Subtype").startswith("/"), F.lit(False)), "Subtype").when(F.coalesce(F.size(rect), F.lit(0)) != 4, "Rect").when(
        quads.isNotNull() & ((F.size(quads) == 0) | (F.size(quads) % 8 != 0)), "QuadPoints"
    )
    return told.select(
        "doc_id", "page_index", "seq", text_value(F.col("Subtype")).alias("subtype"), rect.alias("rect"), text_value(F.col("Contents")).alias("contents"),
        text_value(F.col("S")).alias("action_kind"), text_value(F.col("URI")).alias("uri"), text_value(F.col("M")).alias("modified"),
        F.coalesce(F.col("F").try_cast("int"), F.lit(0)).alias("flags"), F.when(F.size(color).isin(1, 3, 4), color).alias("color"), quads, error.alias("error"),
    )


def form_fields(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Fields with dotted full names; type, flags and value come from the nearest ancestor that has them."""
    form = resolved(roots.select("doc_id", field("catalog", "AcroForm").alias("f")), live, "f")
    tops = form.select("doc_id", F.posexplode(items(field("f", "Fields"))).alias("ord", "r")).select(
        "doc_id", ref(F.col("r")).alias("node"), F.lit(None).cast("int").alias("parent"), "ord"
    )
    kids = live.where(field("value", "Kids").isNotNull()).select("doc_id", F.col("obj").alias("parent"), F.posexplode(items(field("value", "Kids"))).alias("ord", "r"))
    edges = tops.unionByName(kids.select("doc_id", ref(F.col("r")).alias("node"), "parent", "ord"))
    keys = {"FT": "field_type", "Ff": "flags", "V": "value", "DV": "default_value", "Opt": "options", "I": "chosen"}
    values = live.select(
        "doc_id", F.col("obj").alias("node"), text_value(field("value", "T")).alias("name"), *[field("value", k).alias(c) for k, c in keys.items()],
    )
    linked = edges.join(values, ["doc_id", "node"]).withColumn("ord", F.col("ord").cast("long"))
    reached = trees.walk(written(linked, "fields"), ["doc_id"], inherit=tuple(keys.values()))
    own = values.select("doc_id", "node", "name")
    option = items(F.col("options"))

    def shown(o: Column) -> Column:
        return text_value(F.when(o.startswith("["), F.get(items(o), F.lit(1))).otherwise(o))

    def exported(o: Column) -> Column:
        return text_value(F.when(o.startswith("["), F.get(items(o), F.lit(0))).otherwise(o))

    values_of = F.when(F.col("value").startswith("["), F.transform(items(F.col("value")), text_value)).when(F.col("value").isNotNull(), F.array(text_value(F.col("value"))))
    marked = F.from_json("chosen", "array<int>")  # stated indexes; else those of the options that are the value
    matching = F.filter(F.transform(option, lambda o, i: F.when(F.array_contains(values_of, exported(o)) | F.array_contains(values_of, shown(o)), i)), lambda i: i.isNotNull())
    selected = F.when(F.col("options").isNotNull(), F.coalesce(F.filter(marked, lambda i: (i >= 0) & (i < F.size(option))), matching, F.array().cast("array<int>")))
    told = reached.withColumns({"_values": values_of, "_shown": F.transform(option, shown), "_exported": F.transform(option, exported)}).withColumn("_selected", selected)
    return told.join(own, ["doc_id", "node"]).select(
        "doc_id", "node", "parent", F.col("path").alias("full_name"), "name", text_value(F.col("field_type")).alias("field_type"),
        F.coalesce(F.col("flags").try_cast("int"), F.lit(0)).alias("flags"), text_value(F.col("value")).alias("value"), text_value(F.col("default_value")).alias("default_value"),
        F.col("_values").alias("values"), F.col("_shown").alias("options"), F.col("_exported").alias("option_values"), F.col("_selected").alias("selected"), "order",
    )


def form_state(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and whether the form asks for new appearances, of documents with a form."""
    form = resolved(roots.select("doc_id", field("catalog", "AcroForm").alias("f")), live, "f").where("f IS NOT NULL")
    return form.select("doc_id", F.coalesce(field("f", "NeedAppearances") == "true", F.lit(False)).alias("need_appearances"))


def page_labels(live: DataFrame, roots: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_index and label: each page by the range with the greatest start at or before it; decimal from 1 without one.

    The first range begins at page 0 wherever it says it does.
    """
    tree = resolved(roots.select("doc_id", field("catalog", "PageLabels").alias("t")), live, "t").where("t IS NOT NULL")
    direct = tree.select("doc_id", F.posexplode(items(field("t", "Nums"))).alias("i", "key"), items(field("t", "Nums")).alias("pairs"))
    own = direct.where("i % 2 = 0 AND i + 1 < size(pairs)").select("doc_id", F.col("key").try_cast("int").alias("key"), F.get("pairs", F.col("i") + 1).alias("value"))
    starts = roots.select("doc_id", ref(field("catalog", "PageLabels")).alias("node")).where("node IS NOT NULL").join(own, "doc_id", "left_anti")
    ranges = resolved(own.unionByName(number_tree(live, starts)), live, "value").where("key IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) == 1
    spec = F.struct(
        F.when(first, 0).otherwise(F.col("key")).alias("first"), F.substring(field("value", "S"), 2, 2**30).alias("style"),
        F.coalesce(text_value(field("value", "P")), F.lit("")).alias("prefix"), F.coalesce(field("value", "St").try_cast("int"), F.lit(1)).alias("start"),
    )
    rules = ranges.withColumn("spec", spec).select("doc_id", F.col("spec.first").alias("first"), "spec")
    found = sequences.asof(pages.select("doc_id", "page_index"), rules, ["doc_id"], "page_index", "first", "spec")
    s = F.col("spec")
    label = labels.page_label(s["style"], s["prefix"], s["start"], F.col("page_index") - s["first"])
    return found.select("doc_id", "page_index", F.when(s.isNull(), (F.col("page_index") + 1).cast("string")).otherwise(label).alias("label"))


def number_tree(live: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, key, value of the trees that begin at ``starts`` (doc_id, node)."""
    kids = live.select("doc_id", F.col("obj").alias("parent"), F.posexplode(items(field("value", "Kids"))).alias("ord", "kid"))
    edges = kids.select("doc_id", ref(F.col("kid")).alias("node"), "parent", F.col("ord").cast("long").alias("ord"), F.lit("").alias("name"))
    tops = starts.select("doc_id", "node", F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("name"))
    reached = trees.walk(written(edges.unionByName(tops), "number-tree"), ["doc_id"])
    pairs = reached.join(live.select("doc_id", F.col("obj").alias("node"), items(field("value", "Nums")).alias("pairs")), ["doc_id", "node"])
    each = pairs.select("doc_id", "pairs", F.posexplode("pairs").alias("i", "key")).where("i % 2 = 0 AND i + 1 < size(pairs)")
    return each.select("doc_id", F.col("key").try_cast("int").alias("key"), F.get("pairs", F.col("i") + 1).alias("value"))


def resolved_targets(rows: DataFrame, live: DataFrame, named: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` (doc_id, target, ...) with page_index, view, params and ``target_error``.

    A target is an array, a dictionary with D, or a name or string that ``named``
    (:func:`destinations`) has. A page can be a reference or a number from 1.
    """
    held = resolved(rows, live, "target")
    name = F.when(F.col("target").startswith("s:") | F.col("target").startswith("/"), text_value(F.col("target")))
    array = items(F.when(F.col("target").startswith("{"), field("target", "D")).otherwise(F.col("target")))
    own = held.withColumn("_name", name).withColumn("_array", F.when(name.isNull(), array))
    tables_of = named.select("doc_id", F.col("name").alias("_name"), F.col("array").alias("_named"))
    met = own.join(tables_of, ["doc_id", "_name"], "left").withColumn("_array", F.coalesce("_array", "_named"))
    place, view = F.get("_array", F.lit(0)), F.get("_array", F.lit(1))
    need = F.create_map(*[F.lit(x) for pair in VIEW_PARAMETERS.items() for x in pair])[view]
    wrong = F.coalesce(need != F.size("_array") - 2, F.lit(False))
    numbered = F.greatest(F.coalesce(place.try_cast("int"), F.lit(1)) - 1, F.lit(0))
    by_page = pages.select("doc_id", F.col("obj").alias("_page"), F.col("page_index").alias("_at"))
    placed = met.withColumn("_page", ref(place)).join(by_page, ["doc_id", "_page"], "left")
    usable = (F.size("_array") >= 2) & ~wrong
    return (
        placed.withColumn("page_index", F.when(usable, F.when(ref(place).isNotNull(), F.col("_at")).otherwise(numbered)))
        .withColumn("view", F.when(usable, F.substring(view, 2, 2**30)))
        .withColumn("params", F.when(usable, F.transform(F.slice("_array", 3, 8), lambda x: x.try_cast("double"))))
        .withColumn("target_error", F.when(wrong, F.concat(F.substring(view, 2, 2**30), F.lit(": wrong number of parameters"))))
        .drop("_name", "_array", "_named", "_page", "_at")
    )


def target_positions(targets: DataFrame, pages: DataFrame, space: str = "page") -> DataFrame:
    """``targets`` with ``pos``: the anchor of each view in page or screen space; what a view leaves open is the page's top left."""
    n = F.from_json("MediaBox", "array<double>")
    sizes = pages.select(
        "doc_id", "page_index", F.abs(n[3] - n[1]).alias("_high"), page_matrix(space).alias("_m")
    )
    p = F.col("params")
    x = F.when(F.col("view").isin("XYZ", "FitV", "FitBV", "FitR"), p[0])
    y = F.when(F.col("view") == "XYZ", F.get(p, F.lit(1))).when(F.col("view").isin("FitH", "FitBH"), F.get(p, F.lit(0))).when(F.col("view") == "FitR", F.get(p, F.lit(3)))
    at = geometry.point(F.col("_m"), F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.col("_high")))
    return targets.join(sizes, ["doc_id", "page_index"], "left").withColumn("pos", F.array(at["x"], at["y"])).drop("_high", "_m")


#: Kinds of actions whose own fields are read; all others keep their kind only.
ACTION_KINDS = ("GoTo", "GoToR", "GoToE", "URI", "Named", "Launch", "JavaScript")


def actions(rows: DataFrame, live: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, action) as chains: doc_id, key, step, kind, target, file, uri, named, script.

    A plain array is a GoTo. ``Next`` names one action or several; an action that
    a chain has met already ends it.
    """
    first = rows.select("doc_id", "key", F.col("action").alias("a"), F.array().cast("array<string>").alias("trail"), F.array(F.lit(0)).alias("step"))
    found = []
    while True:
        level = written(resolved(first.withColumn("own", F.col("a")), live, "a").where("a IS NOT NULL"), "actions")
        if level.isEmpty():
            break
        found.append(level)
        following = field("a", "Next")
        each = F.when(following.startswith("["), items(following)).otherwise(F.array(following))
        seen = F.array_append("trail", F.col("own"))
        nexts = level.where(following.isNotNull()).select("doc_id", "key", seen.alias("trail"), "step", F.posexplode(each).alias("i", "a"))
        first = nexts.where(~F.array_contains("trail", F.col("a"))).select("doc_id", "key", "a", "trail", F.array_append("step", F.col("i")).alias("step"))
    told = found[0] if found else first.withColumn("own", F.col("a"))
    for level in found[1:]:
        told = told.unionByName(level)
    kind = F.when(F.col("a").startswith("["), "GoTo").otherwise(F.substring(field("a", "S"), 2, 2**30))
    target = F.when(F.col("a").startswith("["), F.col("a")).when(kind.isin("GoTo", "GoToR", "GoToE"), field("a", "D"))
    file = F.coalesce(field("a", "F", "UF"), field("a", "F", "F"), field("a", "F"))
    return told.select(
        "doc_id", "key", "step", kind.alias("kind"), target.alias("target"), F.when(kind.isin("GoToR", "GoToE", "Launch"), text_value(file)).alias("file"),
        F.when(kind == "URI", text_value(field("a", "URI"))).alias("uri"), F.when(kind == "Named", text_value(field("a", "N"))).alias("named"),
        F.when(kind == "JavaScript", text_value(field("a", "JS"))).alias("script"),
    )


_ALT = "struct<Alt:struct<li:array<struct<_VALUE:string,`@lang`:string>>>>"
_PLAIN = ("CreateDate", "ModifyDate", "CreatorTool", "Producer", "Keywords")
#: What is read of a metadata packet; names lose their prefixes, attributes begin with ``@``.
PACKET = (
    f"RDF struct<Description:array<struct<title:{_ALT},description:{_ALT},rights:{_ALT},creator:struct<Seq:struct<li:array<string>>>,subject:struct<Bag:struct<li:array<string>>>,"
    + ",".join(f"{c}:string,`@{c}`:string" for c in _PLAIN)
    + ">>>"
)


def packets(live: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, the catalog's metadata packet as text, and ``error`` where its stream cannot be decoded."""
    own = roots.select("doc_id", ref(field("catalog", "Metadata")).alias("obj")).where("obj IS NOT NULL")
    held = own.join(live.select("doc_id", "obj", F.coalesce("resolved", "value").alias("spec"), "stream"), ["doc_id", "obj"]).where("stream IS NOT NULL")

    def rows_of(row: dict) -> Iterator[dict]:
        try:
            data = filters.decode(row["stream"], json.loads(row["spec"]))
            mark = next((c for b, c in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16")) if data.startswith(b)), "utf-8")
            yield {"doc_id": row["doc_id"], "packet": data.decode(mark, "replace")}
        except filters.FilterIssue as e:
            yield {"doc_id": row["doc_id"], "error": str(e)}

    return expanded(held, rows_of, "doc_id long, packet string, error string")


def metadata(found: DataFrame) -> DataFrame:
    """Fields of :func:`packets`: title, description and rights (map of languages), creators, subjects, dates, tools; of several descriptions the first that has one.

    Dates stay as they are written; ``created`` and ``modified`` are the moments they name. Malformed packets have an ``error``.
    """
    # processing instructions before the packet are no part of its element
    element = F.regexp_extract("packet", r"(?s)(<(?:\w+:)?xmpmeta\b.*</(?:\w+:)?xmpmeta>)", 1)
    whole = F.when(element != "", element).otherwise(F.concat(F.lit("<xmpmeta>"), F.regexp_extract("packet", r"(?s)(<(?:\w+:)?RDF\b.*</(?:\w+:)?RDF>)", 1), F.lit("</xmpmeta>")))
    options = {"ignoreNamespace": "true", "attributePrefix": "@", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
    held = found.withColumn("x", F.from_xml(whole, PACKET, options)).withColumn("d", F.col("x.RDF.Description"))

    def first(pick: Callable[[Column], Column]) -> Column:
        return F.get(F.array_compact(F.transform("d", pick)), F.lit(0))

    def languages(name: str) -> Column:
        listed = first(lambda d: d[name]["Alt"]["li"])
        pairs = F.transform(listed, lambda x: F.struct(F.coalesce(x["@lang"], F.lit("x-default")).alias("key"), x["_VALUE"].alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    def plain(name: str) -> Column:
        return first(lambda d: F.coalesce(d[name], d[f"@{name}"]))

    error = F.coalesce("error", F.when(F.col("d").isNull(), F.lit("no description")))
    return held.select(
        "doc_id", languages("title").alias("title"), languages("description").alias("description"), languages("rights").alias("rights"),
        first(lambda d: d["creator"]["Seq"]["li"]).alias("creators"), first(lambda d: d["subject"]["Bag"]["li"]).alias("subjects"),
        plain("CreateDate").alias("create_date"), plain("ModifyDate").alias("modify_date"), plain("CreateDate").try_cast("timestamp").alias("created"), plain("ModifyDate").try_cast("timestamp").alias("modified"),
        plain("CreatorTool").alias("tool"), plain("Producer").alias("producer"), plain("Keywords").alias("keywords"), error.alias("error"),
    )
