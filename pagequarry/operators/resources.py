"""Resources of pages and forms as a relation, and the operations that select them.

A scope is a page (0) or a form (its object number) on a page. Names are
resolved in their scope by joins; nested forms are found level by level, each
level once, so a form that contains itself ends the search. Pages of a document
mostly share one dictionary, so all this is done once a dictionary (``res``, a
hash of it) and only then spread to the pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.kernels import content as machine
from pagequarry.kernels import filters
from pagequarry.operators.tables import bare, expanded, field, ref
from pagequarry.sources.store import unbroadcast, written

CATEGORIES = ("Font", "XObject", "Properties", "ExtGState", "ColorSpace", "Pattern", "Shading")
SCOPE = ("doc_id", "res", "scope")


def named(scopes: DataFrame, live: DataFrame) -> DataFrame:
    """Entries of the resource dictionaries (column resources) of ``scopes``: category, name, obj and value."""
    values = live.select("doc_id", F.col("obj").alias("_obj"), bare(F.col("value")).alias("_value"), F.col("resolved").alias("_resolved"))

    def followed(df: DataFrame, column: str) -> DataFrame:
        """``column`` with a reference replaced by its value, beside the object number and the resolved value."""
        joined = df.withColumn("_obj", ref(F.col(column))).join(values, ["doc_id", "_obj"], "left")
        return joined.withColumn(column, F.coalesce("_value", column))

    whole = followed(scopes.select(*SCOPE, "resources"), "resources").select(*SCOPE, "resources")
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), field("resources", c).alias("held")) for c in CATEGORIES])
    each = whole.select(*SCOPE, F.explode(kinds).alias("k")).select(*SCOPE, "k.*").where("held IS NOT NULL")
    each = followed(each, "held").select(*SCOPE, "category", F.explode(F.from_json("held", "map<string,string>")).alias("name", "value"))
    return followed(each, "value").select(*SCOPE, "category", "name", F.col("_obj").alias("obj"), "value", F.coalesce("_resolved", "value").alias("spec"))


def with_res(page: DataFrame) -> DataFrame:
    """``page`` with the key of its resource dictionary, null without one."""
    return page.withColumn("res", F.when(F.col("Resources").isNotNull(), F.xxhash64("Resources")))


def shared(live: DataFrame, page: DataFrame, drawn: bool = False) -> DataFrame:
    """Entries of every scope of every dictionary: doc_id, res, scope, category, name, obj, value, spec.

    A form without resources of its own uses those of the scope that names it. With ``drawn`` the resources of Type 3 fonts
    are scopes too: the font's object number, or below 0 where the font is written out in a dictionary.
    """
    is_form = (F.col("category") == "XObject") & F.col("obj").isNotNull() & F.coalesce(field("value", "Subtype") == "/Form", F.lit(False))
    is_drawn = (F.col("category") == "Font") & F.coalesce(field("value", "Subtype") == "/Type3", F.lit(False)) & F.lit(drawn)
    own = with_res(page.select("doc_id", "Resources")).where("res IS NOT NULL").groupBy("doc_id", "res").agg(F.min("Resources").alias("resources"))
    scopes = own.select("doc_id", "res", F.lit(0).alias("scope"), "resources")
    found, seen = [], None
    while True:
        level = written(named(scopes, live), "resources")
        found.append(level)
        holders = level.where(is_form | is_drawn)
        if holders.isEmpty():
            break
        above = scopes.select(*SCOPE, F.col("resources").alias("_above"))
        named_by = F.coalesce("obj", (-1 - F.pmod(F.xxhash64("value"), F.lit(2**31 - 1))).cast("int"))
        inner = holders.join(above, [*SCOPE]).select(
            "doc_id", "res", named_by.alias("scope"), F.coalesce(field("value", "Resources"), F.when(is_form, F.col("_above"))).alias("resources")
        )
        done = scopes.select(*SCOPE) if seen is None else seen.union(scopes.select(*SCOPE))
        seen = written(done, "resource-scopes")
        fresh = inner.where("resources IS NOT NULL").join(seen, [*SCOPE], "left_anti")
        scopes = written(fresh.groupBy(*SCOPE).agg(F.min("resources").alias("resources")), "resource-scopes")
        if scopes.isEmpty():
            break
    return unbroadcast(reduce(DataFrame.unionByName, found))


def on_pages(entries: DataFrame, page: DataFrame) -> DataFrame:
    """The entries of :func:`shared` for every page that has their dictionary: doc_id, page_index, scope, category, name, obj, value, spec."""
    return with_res(page.select("doc_id", "page_index", "Resources")).drop("Resources").join(entries, ["doc_id", "res"]).drop("res")


def resources(live: DataFrame, page: DataFrame) -> DataFrame:
    """Entries of every scope of every page."""
    return on_pages(shared(live, page), page)


def char_procs(live: DataFrame, entries: DataFrame) -> DataFrame:
    """Glyph procedures of Type 3 fonts: doc_id, res, scope, name (the font's), glyph, obj, width and bbox as their first operator (d0 or d1) states them, error.

    Widths and boxes are in the font's own units; a box's corners are put in order. A procedure is read to its end: one with malformed syntax anywhere states nothing.
    """
    fonts = entries.where("category = 'Font'").where(field("value", "Subtype") == "/Type3").select(*SCOPE, "name", field("value", "CharProcs").alias("held"))
    values = live.select("doc_id", F.col("obj").alias("_obj"), "value")
    held = fonts.withColumn("_obj", ref(F.col("held"))).join(values, ["doc_id", "_obj"], "left").withColumn("held", F.coalesce("value", "held"))
    each = held.select(*SCOPE, "name", F.explode(F.from_json("held", "map<string,string>")).alias("glyph", "r")).withColumn("obj", ref(F.col("r")))
    streams = live.where("stream IS NOT NULL").select("doc_id", "obj", F.coalesce("resolved", "value").alias("spec"), "stream")

    def rows_of(row: dict) -> Iterator[dict]:
        out = {k: row[k] for k in ("doc_id", "res", "scope", "name", "glyph", "obj")}
        try:
            data = filters.decode(row["stream"], json.loads(row["spec"])) if row["stream"] is not None else b""
            every = machine.operations(data)
            op, operands, _ = first = next(every, ("", [], 0))
            wrong = next((a[0] for o, a, _ in chain([first], every) if o == "error"), None)
            need = {"d0": 2, "d1": 6}.get(op)
            if wrong or need is None:
                yield out | {"error": wrong or (None if op else "empty procedure")}
                return
            numbers = [float(x) for x in operands if isinstance(x, (int, float))]
            if len(numbers) != need or len(operands) != need:
                yield out | {"error": f"{op}: wrong operands"}
                return
            box = numbers[2:]
            yield out | {"width": numbers[0], "bbox": [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])] if box else None}
        except filters.FilterIssue as e:
            yield out | {"error": str(e)}

    schema = "doc_id long, res long, scope int, name string, glyph string, obj int, width double, bbox array<double>, error string"
    return expanded(each.drop("r").join(streams, ["doc_id", "obj"], "left"), rows_of, schema)


def parent_maps(streams: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, code_obj and ``parents`` (spec and stream) of the character maps that each map of ``own`` builds on, the furthest first."""
    level = own.select("doc_id", "code_obj", F.col("code_obj").alias("at"), F.array("code_obj").alias("trail"))
    specs = streams.select("doc_id", F.col("obj").alias("at"), ref(field("s", "UseCMap")).alias("next")).where("next IS NOT NULL")
    found = []
    while True:
        level = level.join(specs, ["doc_id", "at"]).where(~F.array_contains("trail", F.col("next")))
        level = written(level.select("doc_id", "code_obj", F.col("next").alias("at"), F.array_append("trail", F.col("next")).alias("trail")), "parent-maps")
        if found and level.isEmpty():
            break
        found.append(level)
    maps = streams.select("doc_id", F.col("obj").alias("at"), F.col("s").alias("spec"), "stream")
    every = unbroadcast(reduce(DataFrame.unionByName, found)).join(maps, ["doc_id", "at"])
    order = F.sort_array(F.collect_list(F.struct((-F.size("trail")).alias("depth"), "spec", "stream")))
    return every.groupBy("doc_id", "code_obj").agg(F.transform(order, lambda x: F.struct(x["spec"].alias("spec"), x["stream"].alias("stream"))).alias("parents"))


def dictionaries(live: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, res and ``named``: what the page machine needs of fonts, properties, graphics states, forms and images, from :func:`shared`; once a dictionary."""
    shape = field("value", "Subtype")
    wanted = entries.where(F.col("category").isin("Font", "Properties", "ExtGState") | ((F.col("category") == "XObject") & shape.isin("/Form", "/Image")))
    is_font = F.col("category") == "Font"
    keyed = wanted.withColumn("map_obj", F.when(is_font, ref(field("value", "ToUnicode")))).withColumn("code_obj", F.when(is_font, ref(field("value", "Encoding"))))
    streams = live.where("stream IS NOT NULL AND NOT shown").select("doc_id", "obj", F.coalesce("resolved", "value").alias("s"), "stream")

    def with_stream(df: DataFrame, key: str, prefix: str) -> DataFrame:
        own = streams.select("doc_id", F.col("obj").alias(key), F.col("s").alias(f"{prefix}spec_"), F.col("stream").alias(f"{prefix}stream"))
        return df.join(own, ["doc_id", key], "left")

    joined = with_stream(with_stream(keyed, "map_obj", "map_"), "code_obj", "code_")
    forms = joined.withColumn("form_obj", F.when(shape == "/Form", F.col("obj")))
    full = with_stream(forms, "form_obj", "")
    maps = keyed.where("code_obj IS NOT NULL").select("doc_id", "code_obj").distinct()
    full = full.join(parent_maps(streams, maps), ["doc_id", "code_obj"], "left")
    procs = char_procs(live, entries).where("width IS NOT NULL").groupBy(*SCOPE, "name").agg(F.sort_array(F.collect_list(F.struct("glyph", "width"))).alias("procs"))
    full = full.join(procs.withColumn("category", F.lit("Font")), [*SCOPE, "category", "name"], "left")
    packed = F.struct(
        "scope", "category", "name", "obj", "spec", "stream", F.col("map_spec_").alias("map_spec"), "map_stream", F.col("code_spec_").alias("code_spec"), "code_stream",
        "parents", "procs",
    )
    return full.groupBy("doc_id", "res").agg(F.collect_list(packed).alias("named"))


def form_pages(page: DataFrame, entries: DataFrame) -> DataFrame:
    """Every form of every dictionary as a view of its own, on the first page that has the dictionary: rows for :func:`tables.folding`."""
    own = with_res(page).where("res IS NOT NULL").groupBy("doc_id", "res").agg(F.min("page_index").alias("page_index"))
    found = entries.where("category = 'XObject' AND obj IS NOT NULL").where(field("value", "Subtype") == "/Form")
    each = found.groupBy("doc_id", "res", F.col("obj").alias("scope")).agg(F.count(F.lit(1)))
    return own.join(each, ["doc_id", "res"]).select("doc_id", "page_index", "res", "scope", F.lit("{}").alias("value"), F.lit(None).cast("array<double>").alias("matrix"))


def images(entries: DataFrame) -> DataFrame:
    """Image resources of each page in order of their names, painted or not."""
    found = entries.where("scope = 0 AND category = 'XObject'").where(field("value", "Subtype") == "/Image")
    return found.select(
        "doc_id", "page_index", "name", "obj", field("value", "Width").try_cast("int").alias("width"), field("value", "Height").try_cast("int").alias("height"),
        F.coalesce(field("value", "BitsPerComponent").try_cast("int"), F.lit(1)).alias("bits"), field("value", "ColorSpace").alias("color_space"),
        field("spec", "Filter").alias("filter"), field("value", "SMask").isNotNull().alias("soft_mask"),
    )


def forms(entries: DataFrame) -> DataFrame:
    """Form resources of every scope with box, matrix, group and structure key; ``scope`` names the form that holds them."""
    found = entries.where("category = 'XObject'").where(field("value", "Subtype") == "/Form")
    return found.select(
        "doc_id", "page_index", "scope", "name", "obj", F.from_json(field("value", "BBox"), "array<double>").alias("bbox"),
        F.coalesce(F.from_json(field("value", "Matrix"), "array<double>"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])).alias("matrix"),
        field("value", "Group", "S").alias("group"), field("value", "StructParent").try_cast("int").alias("struct_parent"),
    )


#: Operators that select a resource by their last name operand, and the category they look in.
SELECTORS = {"gs": "ExtGState", "CS": "ColorSpace", "cs": "ColorSpace", "SCN": "Pattern", "scn": "Pattern", "sh": "Shading", "BDC": "Properties", "DP": "Properties", "Do": "XObject", "Tf": "Font"}
#: Names that stand for themselves where no resource has them.
BUILT_IN = ("DeviceGray", "DeviceRGB", "DeviceCMYK", "Pattern")


def selections(operations: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per operation of a page that selects a resource: seq, operator, category, name, obj, value; ``known`` if it is there.

    Device colour spaces need no resource.
    """
    category = F.create_map(*[F.lit(x) for pair in SELECTORS.items() for x in pair])[F.col("operator")]
    operands = F.from_json("operands", "array<string>")
    last = F.when(F.col("operator") == "Tf", F.get(operands, F.lit(0))).otherwise(F.element_at(operands, -1))
    name = F.regexp_extract(last, "^/(.+)$", 1)
    chosen = operations.where(F.col("operator").isin(*SELECTORS)).select("doc_id", "page_index", "seq", "operator", category.alias("category"), name.alias("name"))
    own = entries.where("scope = 0").select("doc_id", "page_index", "category", "name", "obj", "value")
    found = chosen.where("name <> ''").join(own, ["doc_id", "page_index", "category", "name"], "left")
    return found.withColumn("known", F.col("value").isNotNull() | ((F.col("category") == "ColorSpace") & F.col("name").isin(*BUILT_IN)))
