"""A corpus of documents as relations.

Bytes are read once per document (:func:`parts`) and once per page
(:func:`interpreted`) by small Arrow-batched helpers; from there on everything
(revisions, page tree, inheritance, resources, content order, text assembly) is
joins, windows and tree walks on keys that begin with doc_id. Malformed input
never fails a job: the row carries ``error``.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from itertools import islice
from operator import attrgetter, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.functions import geometry
from pagequarry.kernels import content as machine
from pagequarry.kernels import document, filters, fonts, syntax
from pagequarry.operators import sequences, trees
from pagequarry.sources.store import written

OBJECT_COLUMNS = ("doc_id", "seq", "obj", "gen", "offset", "container", "value", "stream", "resolved", "live", "repaired", "shown", "error")
PARTS = (
    "doc_id long, kind string, seq int, obj int, gen int, `offset` long, container int, idx int, rev int, free boolean, live boolean, "
    "repaired boolean, shown boolean, value string, resolved string, stream binary, error string"
)
GLYPH = "struct<text:string,x:double,y:double,dx:double,dy:double>"
MARK = "struct<id:int,tag:string,mcid:int,actual:string>"
COLOR = "struct<space:string,values:array<double>,pattern:string>"
LINE = "struct<width:double,cap:int,join:int,miter:double,dash:array<double>,phase:double>"
EFFECTS = "struct<soft_mask:string,alpha_is_shape:boolean,knockout:boolean,overprint_stroke:boolean,overprint_fill:boolean,overprint_mode:int,halftone:string>"
CONTENT = (
    f"doc_id long, page_index int, seq int, kind string, name string, size double, x double, y double, glyphs array<{GLYPH}>, "
    f"marked array<{MARK}>, bbox array<double>, stroke boolean, fill boolean, even_odd boolean, "
    f"segments array<struct<op:string,points:array<double>>>, `offset` long, scope int, stroke_color {COLOR}, fill_color {COLOR}, line {LINE}, "
    f"stroke_alpha double, fill_alpha double, blend string, effects {EFFECTS}, clips int, error string"
)


#: Rows, bytes and glyphs at which a batch goes out: rows may be long, so their number alone bounds nothing.
BATCH_ROWS, BATCH_BYTES, BATCH_GLYPHS = 2000, 4 << 20, 50_000
#: Columns whose values may be long.
LONG = ("content", "value", "stream", "text", "operands")


def expanded(df: DataFrame, rows_of: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Each row of ``df`` as the rows that ``rows_of`` makes of it, in Arrow batches of bounded size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    lengthy = [c for c in LONG if c in arrow.names]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        room = BATCH_BYTES
        for batch in batches:
            names, columns = batch.schema.names, batch.columns
            for i in range(batch.num_rows):
                for row in rows_of({n: c[i].as_py() for n, c in zip(names, columns, strict=True)}):
                    held.append(row)
                    for c in lengthy:
                        if value := row.get(c):
                            room -= len(value)
                    if len(held) >= BATCH_ROWS or room < 0:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, room = [], BATCH_BYTES
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(of, schema)


def field(value: Column | str, *path: str) -> Column:
    """A member of a JSON value, as a string."""
    return F.get_json_object(value, "$" + "".join(f"['{p}']" for p in path))


def ref(value: Column) -> Column:
    """Object number of a reference, else null."""
    return F.regexp_extract(value, r"^(\d+) \d+ R$", 1).try_cast("int")


def bare(value: Column) -> Column:
    """A value as it would stand inside another: strings, names and references lose their quotes."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")).otherwise(value)


def parts(corpus: DataFrame, pages: Collection[int] | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """Everything that one pass over each document's bytes gives, by ``kind``: object, section, entry, document.

    Objects come in source order, those of object streams right behind their
    container; ``live`` marks the ones that the newest cross-reference entries (or,
    in a recovered document, the first declarations) make current, ``shown`` the
    streams that pages show. With ``pages`` (numbers from 0) the content of other
    pages is left where it is: it is neither written nor moved. With ``kinds`` rows of others are not made.
    """
    chosen = None if pages is None else frozenset(pages)
    made = None if kinds is None else frozenset(kinds)

    def rows_of(doc: dict) -> Iterator[dict]:
        for row in document.read(doc["content"] or b"", chosen, made):
            row["doc_id"] = doc["doc_id"]
            yield row

    return expanded(corpus.select("doc_id", "content"), rows_of, PARTS)


def objects(found: DataFrame) -> DataFrame:
    """Every object in source order, older revisions included; of :func:`parts`, or of a corpus."""
    found = parts(found, kinds=("object",)) if "content" in found.columns else found
    return found.where("kind = 'object'").select(*OBJECT_COLUMNS)


def current(objs: DataFrame) -> DataFrame:
    """The current version of each object number."""
    return objs.where("live")


def sections(found: DataFrame) -> DataFrame:
    """Cross-reference sections: doc_id, rev (0 is the newest), offset and trailer."""
    return found.where("kind = 'section'").select("doc_id", "rev", "offset", F.col("value").alias("trailer"))


def xrefs(found: DataFrame) -> DataFrame:
    """Entries of all sections: doc_id, rev, obj, gen, free, offset or container and index."""
    return found.where("kind = 'entry'").select("doc_id", "rev", "obj", "gen", "free", "offset", "container", "idx")


def newest_entries(found: DataFrame) -> DataFrame:
    """The newest entry of each object number and generation; free ones stay."""
    at = F.struct("rev", "free", "offset", "container", "idx")
    newest = xrefs(found).groupBy("doc_id", "obj", "gen").agg(F.min(at).alias("e"))
    return newest.select("doc_id", "obj", "gen", "e.*")


def states(found: DataFrame) -> DataFrame:
    """One row per document: version of the header, merged trailer, whether it was recovered, and the error that led to it."""
    return found.where("kind = 'document'").select(
        "doc_id", field("value", "version").alias("header_version"), field("value", "trailer").alias("trailer"),
        F.col("error").isNotNull().alias("recovered"), F.col("error").alias("recovery_error"),
    )


def catalog(live: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with root (object number of the catalog), catalog value, version and whether the document is tagged."""
    rooted = state.withColumn("root", ref(field("trailer", "Root")))
    found = live.select("doc_id", F.col("obj").alias("root"), F.col("value").alias("catalog"))
    version = F.coalesce(F.regexp_extract(field("catalog", "Version"), r"^/(.+)$", 1), "header_version")
    tagged = F.coalesce(field("catalog", "MarkInfo", "Marked") == "true", F.lit(False))
    return rooted.join(found, ["doc_id", "root"], "left").withColumn("version", version).withColumn("tagged", tagged)


def tokens(corpus: DataFrame) -> DataFrame:
    """Token sequence of the raw bytes, streams skipped: doc_id, seq, kind, text, number, offset."""

    def rows_of(doc: dict) -> Iterator[dict]:
        data, seq, at = doc["content"] or b"", 0, 0
        row = {"doc_id": doc["doc_id"]}
        try:
            while t := next(syntax.tokens(data, at), None):
                kind, value, begin, at = t
                if kind == "keyword" and value == "stream":
                    end = data.find(b"endstream", at)
                    at = len(data) if end < 0 else end
                text = value.hex() if isinstance(value, bytes) else None if kind == "number" else value
                yield row | {"seq": seq, "kind": kind, "text": text, "number": float(value) if kind == "number" else None, "offset": begin}
                seq += 1
        except syntax.SyntaxIssue as e:
            yield row | {"seq": seq, "kind": "error", "text": str(e), "offset": e.offset}

    return expanded(corpus.select("doc_id", "content"), rows_of, "doc_id long, seq int, kind string, text string, number double, `offset` long")


INHERITED = ("MediaBox", "CropBox", "Resources", "Rotate", "UserUnit")


def pages(live: DataFrame, roots: DataFrame, chosen: Collection[int] | None = None) -> DataFrame:
    """Leaves of the page tree in order, with inherited attributes as JSON; of ``chosen`` page numbers only, if given.

    A document whose tree has no pages gives its page dictionaries in source order. A page that
    the tree names again has an ``error`` there.
    """
    # values are read once; those that can be no node of the tree are told by their text
    likely = live.where(F.col("value").contains('"Kids"') | F.col("value").contains('"/Page"'))
    told = likely.select("doc_id", F.col("obj").alias("node"), "gen", "seq", "value", F.json_tuple("value", "Type", "Kids", *INHERITED).alias("Type", "Kids", *INHERITED))
    sound = F.coalesce("Type", F.lit("/Pages")).isin("/Page", "/Pages") & (F.col("Kids").isNotNull() | (F.col("Type") == "/Page"))
    nodes = written(told.where(sound), "page-tree")
    kids = nodes.select("doc_id", F.col("node").alias("parent"), F.posexplode(F.from_json("Kids", "array<string>")).alias("ord", "kid"))
    edges = kids.select("doc_id", "parent", F.col("ord").cast("long").alias("ord"), ref(F.col("kid")).alias("node"))
    tops = roots.select("doc_id", F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("ord"), ref(field("catalog", "Pages")).alias("node"))
    values = nodes.withColumn("name", F.lit(""))
    linked = written(edges.unionByName(tops).join(values.select("doc_id", "node", "name", *INHERITED), ["doc_id", "node"]), "page-nodes")  # read once per level
    reached = trees.walk(linked, ["doc_id"], inherit=INHERITED).select("doc_id", "node", "order", *INHERITED)
    own = values.where("Kids IS NULL").select("doc_id", "node", "gen", "seq", "value")
    leaves = reached.join(own, ["doc_id", "node"])
    scanned = values.where("Type = '/Page'").withColumn("order", F.array(F.col("seq").cast("long")))
    loose = scanned.join(leaves.select("doc_id").distinct(), "doc_id", "left_anti").select(*leaves.columns)
    place = Window.partitionBy("doc_id").orderBy("order")
    again = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("order")) > 1
    found = leaves.unionByName(loose).withColumn("page_index", F.row_number().over(place) - 1)
    found = found.select(
        "doc_id", "page_index", F.col("node").alias("obj"), "gen", "value", *INHERITED, F.when(again, "the tree names the page again").alias("error")
    )
    return found if chosen is None else found.where(F.col("page_index").isin(*chosen))


def page_geometry(page: DataFrame) -> DataFrame:
    """Boxes, size, rotation and unit of each page; the size follows the media box and unit, not the rotation."""

    def box(name: str) -> Column:
        n = F.from_json(F.col(name), "array<double>")
        return F.when(F.size(n) == 4, F.array(F.least(n[0], n[2]), F.least(n[1], n[3]), F.greatest(n[0], n[2]), F.greatest(n[1], n[3])))

    unit = F.coalesce(F.col("UserUnit").cast("double"), F.lit(1.0))
    found = page.withColumn("mediabox", box("MediaBox")).withColumn("cropbox", F.coalesce(box("CropBox"), F.col("mediabox")))
    return found.select(
        "doc_id", "page_index", (F.col("page_index") + 1).alias("page_number"), "obj", "gen", "mediabox", "cropbox",
        ((F.col("mediabox")[2] - F.col("mediabox")[0]) * unit).alias("width"), ((F.col("mediabox")[3] - F.col("mediabox")[1]) * unit).alias("height"),
        F.pmod(F.coalesce(F.col("Rotate").cast("int"), F.lit(0)), F.lit(360)).alias("rotation"), unit.alias("user_unit"),
    )


def object_at(live: DataFrame, found: DataFrame) -> DataFrame:
    """Current objects of the (doc_id, obj) rows in ``found``; the newest generation is the current one."""
    return live.join(found.select("doc_id", "obj").distinct(), ["doc_id", "obj"], "left_semi")


def chained(rows: DataFrame, live: DataFrame, column: str) -> DataFrame:
    """``rows`` with references to references in ``column`` followed to a value; a cycle, or nothing there, gives null."""
    values = live.select("doc_id", F.col("obj").alias("_obj"), bare(F.col("value")).alias("_value"))
    met = rows.withColumn("_trail", F.array().cast("array<string>"))
    while True:
        met = written(met, "chain")
        if met.where(ref(F.col(column)).isNotNull()).isEmpty():
            break
        again = F.array_contains("_trail", F.col(column))
        step = met.withColumn("_obj", F.when(~again, ref(F.col(column)))).join(values, ["doc_id", "_obj"], "left")
        value = F.when(ref(F.col(column)).isNull(), F.col(column)).otherwise(F.col("_value"))
        met = step.withColumn("_trail", F.array_append("_trail", F.col(column))).withColumn(column, value).drop("_obj", "_value")
    return met.drop("_trail")


def pages_found(page: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages by ``wanted`` (doc_id and one of page_index, obj or label): of equal labels the first page."""
    if "label" in wanted.columns:
        first = labels.groupBy("doc_id", "label").agg(F.min("page_index").alias("page_index"))
        wanted = wanted.join(first, ["doc_id", "label"])
    key = "obj" if "obj" in wanted.columns else "page_index"
    return page.join(wanted.select("doc_id", key).distinct(), ["doc_id", key], "left_semi")


def page_matrix(space: str) -> Column:
    """Matrix of a row of :func:`pages` into ``space``: page (origin bottom left), screen (y down) or default (as written)."""
    n = F.from_json("MediaBox", "array<double>")
    box = F.array(F.least(n[0], n[2]), F.least(n[1], n[3]), F.greatest(n[0], n[2]), F.greatest(n[1], n[3]))
    turn = F.pmod(F.coalesce(F.col("Rotate").try_cast("int"), F.lit(0)), F.lit(360))
    unit = F.coalesce(F.col("UserUnit").try_cast("double"), F.lit(1.0))
    scaled = F.transform(geometry.page_matrix(box, turn, space), lambda v: v * unit)
    return F.when(F.size(n) == 4, scaled) if space != "default" else F.lit(None).cast("array<double>")


def page_streams(live: DataFrame, page: DataFrame, *keep: str) -> DataFrame:
    """doc_id, page_index, the columns ``keep`` and the page's content streams, in order, as (ord, spec, raw).

    Streams move once, to the pages that name them; only pages of several
    streams are gathered after that.
    """
    contents = field("value", "Contents")
    one = page.select("doc_id", "page_index", *keep, contents.alias("c"))
    arrays = live.where(F.col("value").startswith("[")).select("doc_id", F.col("obj").alias("_obj"), F.col("value").alias("_array"))
    one = one.withColumn("_obj", ref(F.col("c"))).join(arrays, ["doc_id", "_obj"], "left").withColumn("c", F.coalesce("_array", "c")).drop("_obj", "_array")
    listed = F.when(F.col("c").startswith("["), F.from_json("c", "array<string>")).otherwise(F.array("c"))
    wanted = one.select("doc_id", "page_index", *keep, F.size(listed).alias("n"), F.posexplode_outer(listed).alias("ord", "r")).withColumn("obj", ref(F.col("r")))
    streams = live.where("stream IS NOT NULL").select("doc_id", "obj", F.coalesce("resolved", "value").alias("spec"), F.col("stream").alias("raw"))
    part = F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "spec", "raw")
    # pages are small in bytes and costly to read: the number of partitions is stated, so that few bytes do not end in few tasks
    slots = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams, wanted = streams.repartition(slots, "doc_id", "obj"), wanted.repartition(slots, "doc_id", "obj")
    single = wanted.where("n <= 1").join(streams, ["doc_id", "obj"], "left").select("doc_id", "page_index", *keep, F.array(part).alias("streams"))
    several = wanted.where("n > 1").join(streams, ["doc_id", "obj"], "left")
    gathered = several.groupBy("doc_id", "page_index").agg(*[F.first(k).alias(k) for k in keep], F.sort_array(F.collect_list(part)).alias("streams"))
    return single.unionByName(gathered)


def joined_streams(streams: list[dict] | None) -> tuple[bytes, list[int], str | None]:
    """Decoded streams joined by line feeds, where those after the first begin, and what was wrong with those that could not be decoded."""
    out, errors = [], []
    for s in streams or ():
        try:
            out.append(filters.decode(s["raw"], json.loads(s["spec"]), lenient=True) if s["raw"] is not None else b"")
        except filters.FilterIssue as e:
            out.append(b"")
            errors.append(str(e))
    cuts, at = [], 0
    for part in out[:-1]:
        at += len(part) + 1
        cuts.append(at)
    return b"\n".join(out), cuts, "; ".join(errors) or None


def page_bytes(live: DataFrame, page: DataFrame) -> DataFrame:
    """doc_id, page_index, the page's decoded content, ``cuts`` where further streams begin, and the ``error`` of those that could not be decoded."""

    def rows_of(p: dict) -> Iterator[dict]:
        data, cuts, error = joined_streams(p["streams"])
        yield {"doc_id": p["doc_id"], "page_index": p["page_index"], "content": data, "cuts": cuts, "error": error}

    return expanded(page_streams(live, page), rows_of, "doc_id long, page_index int, content binary, cuts array<int>, error string")


def operations(content: DataFrame) -> DataFrame:
    """Content operations in order: doc_id, page_index, seq, operator, operands (JSON), offset; of :func:`page_bytes`.

    Malformed syntax ends its stream with a row that has no operator but an ``error``.
    """
    cuts = F.col("cuts") if "cuts" in content.columns else F.array().cast("array<int>")

    def rows_of(page: dict) -> Iterator[dict]:
        for k, (op, operands, at) in enumerate(machine.operations(page["content"] or b"", page["cuts"] or ())):
            row = {"doc_id": page["doc_id"], "page_index": page["page_index"], "seq": k, "offset": at}
            yield row | ({"error": operands[0]} if op == "error" else {"operator": op, "operands": json.dumps(operands)})

    schema = "doc_id long, page_index int, seq int, operator string, operands string, `offset` long, error string"
    return expanded(content.select("doc_id", "page_index", "content", cuts.alias("cuts")), rows_of, schema)


def operation_counts(content: DataFrame) -> DataFrame:
    """How often each operator stands in a page: doc_id, page_index, operator, n; of :func:`page_bytes`. Malformed streams count under a null operator."""
    cuts = F.col("cuts") if "cuts" in content.columns else F.array().cast("array<int>")

    def rows_of(page: dict) -> Iterator[dict]:
        counted = Counter(map(itemgetter(0), machine.operations(page["content"] or b"", page["cuts"] or ())))
        for op, n in counted.items():
            yield {"doc_id": page["doc_id"], "page_index": page["page_index"], "operator": None if op == "error" else op, "n": n}

    return expanded(content.select("doc_id", "page_index", "content", cuts.alias("cuts")), rows_of, "doc_id long, page_index int, operator string, n long")


class Runs:
    """Rows of the page machine as Arrow columns; glyphs are kept as flat columns and never as objects."""

    PLAIN = ("doc_id", "page_index", "seq", "kind", "name", "size", "x", "y", "marked", "bbox", "stroke", "fill", "even_odd", "segments", "offset", "scope", "error")

    EFFECTS = ("soft_mask", "alpha_is_shape", "knockout", "overprint_stroke", "overprint_fill", "overprint_mode", "halftone")
    #: What the columns of the graphics state are made of.
    STATE = ("stroke", "fill", "width", "cap", "join", "miter", "dash", "phase", "stroke_alpha", "fill_alpha", "blend", "clips", *EFFECTS)

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.values_of = schema, attrgetter(*self.STATE)
        self.clear()

    def clear(self) -> None:
        self.plain = {c: [] for c in self.PLAIN}
        self.columns = [(c, held.append) for c, held in self.plain.items()]
        self.texts, self.places, self.ends, self.missing = [], [array("d") for _ in range(4)], [0], []
        self.state = {c: [] for c in ("stroke_color", "fill_color", "line", "effects", "stroke_alpha", "fill_alpha", "blend", "clips")}
        self.met, self.at = {}, []

    def add(self, doc_id: int, page_index: int, row: dict) -> None:
        row["doc_id"], row["page_index"] = doc_id, page_index
        for c, append in self.columns:
            append(row.get(c))
        glyphs, state = row.get("glyphs"), row.get("state")
        self.missing.append(glyphs is None)
        if glyphs:
            self.texts += glyphs[0]
            for held, new in zip(self.places, glyphs[1:], strict=True):
                held.fromlist(new)
        self.ends.append(len(self.texts))
        key = None if state is None else self.values_of(state)
        found = self.met.get(key)
        if found is None:  # few states hold for many rows: each is written out once a batch
            found = self.met[key] = len(self.met)
            self.add_state(state)
        self.at.append(found)

    def add_state(self, state: machine.State | None) -> None:
        if state is None:
            for held in self.state.values():
                held.append(None)
            return
        for name, (space, values, pattern) in (("stroke_color", state.stroke), ("fill_color", state.fill)):
            self.state[name].append({"space": space, "values": values, "pattern": pattern})
        self.state["line"].append({"width": state.width, "cap": state.cap, "join": state.join, "miter": state.miter, "dash": state.dash, "phase": state.phase})
        self.state["effects"].append({c: getattr(state, c) for c in self.EFFECTS})
        for c in ("stroke_alpha", "fill_alpha", "blend", "clips"):
            self.state[c].append(getattr(state, c))

    def batch(self) -> pa.RecordBatch:
        fields = [pa.array(self.texts, pa.string()), *[pa.array(np.array(p, np.float64)) for p in self.places]]
        kind = self.schema.field("glyphs").type
        struct = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
        glyphs = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), struct, type=kind, mask=pa.array(self.missing))
        columns = {c: pa.array(v, self.schema.field(c).type) for c, v in self.plain.items()} | {"glyphs": glyphs}
        at = pa.array(self.at, pa.int32())
        columns |= {c: pa.array(v, self.schema.field(c).type).take(at) for c, v in self.state.items()}
        out = pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema], schema=self.schema)
        self.clear()
        return out


def listed_contents(live: DataFrame, page: DataFrame, *keep: str) -> DataFrame:
    """doc_id, page_index, ``keep`` and the object numbers of the page's content streams, in order."""
    arrays = live.where(F.col("value").startswith("[")).select("doc_id", F.col("obj").alias("_obj"), F.col("value").alias("_array"))
    one = page.select("doc_id", "page_index", *keep, field("value", "Contents").alias("c")).withColumn("_obj", ref(F.col("c")))
    found = F.coalesce("_array", "c")
    numbers = F.transform(F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.array(found)), ref)
    return one.join(arrays, ["doc_id", "_obj"], "left").select("doc_id", "page_index", *keep, numbers.alias("contents"))


def folding(live: DataFrame, page: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """What the page machine reads, a document in one place: its resource dictionaries, then its content streams, then its pages.

    ``page`` has res (the key of its dictionary) and matrix; ``scope`` may name a form that is a view of its own.
    Every stream and every dictionary moves once, whatever the number of pages that share it; a task holds
    those of one document, whose bytes one task has read before.
    """
    scope = F.col("scope") if "scope" in page.columns else F.lit(0)
    named_type = dictionaries.schema["named"].dataType
    columns = {"at": "int", "res": "long", "scope": "int", "matrix": "array<double>", "contents": "array<int>", "spec": "string", "raw": "binary", "named": named_type}

    def rows(df: DataFrame, part: int, **given: Column) -> DataFrame:
        return df.select("doc_id", F.lit(part).alias("part"), *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])

    streams = live.where("shown AND stream IS NOT NULL")
    shown = listed_contents(live, page.withColumn("scope", scope), "res", "matrix", "scope")
    all_rows = (
        rows(dictionaries, 0, res=F.col("res"), named=F.col("named"))
        .unionByName(rows(streams, 1, at=F.col("obj"), spec=F.coalesce("resolved", "value"), raw=F.col("stream")))
        .unionByName(rows(shown, 2, at=F.col("page_index"), res=F.col("res"), scope=F.col("scope"), matrix=F.col("matrix"), contents=F.col("contents")))
    )
    # pages are small in bytes and costly to read: the number of partitions is stated, so that few bytes do not end in few tasks
    slots = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return all_rows.repartition(slots, "doc_id").sortWithinPartitions("doc_id", "part", "at", "scope")


def interpreted(
    rows: DataFrame, flatten: bool = False, kinds: Collection[str] | None = None, operators: Collection[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Text runs, paths, images, forms and tags of each page in paint order; of :func:`folding`.

    With ``flatten`` forms are expanded in place. ``kinds`` and ``operators`` reach the fold: rows of others are
    not made. With ``limit`` a page is read no further than to that many rows. A stream that cannot be decoded or
    ends in malformed syntax, and a form that cannot be decoded, give a row of kind ``error``.
    """
    arrow = to_arrow_schema(StructType.fromDDL(CONTENT))
    wanted = {"kinds": None if kinds is None else frozenset(kinds), "operators": None if operators is None else frozenset(operators)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(arrow)
        for (doc_id, page_index), scope, own, errors, matrix, data, cuts in read_pages(batches):
            for what in errors:
                runs.add(doc_id, page_index, {"seq": -1, "kind": "error", "error": what, "scope": scope})
            found = machine.Machine(matrix=matrix, scopes=own, flatten=flatten, **wanted).run(data, cuts, scope or 0)
            for row in islice(found, limit):
                runs.add(doc_id, page_index, row)
                if len(runs.missing) >= BATCH_ROWS or len(runs.texts) >= BATCH_GLYPHS:
                    yield runs.batch()
        if runs.missing:
            yield runs.batch()

    return rows.mapInArrow(of, CONTENT)


def placed(rows: DataFrame, fold: Callable[[machine.Placed], list], schema: str, flatten: bool = False) -> DataFrame:
    """Columns of ``schema`` that ``fold`` makes of the shown text of whole pages where they are read; of :func:`folding`.

    A page's text is in order there already: no run or glyph becomes a row that moves unless ``fold`` makes it one.
    Pages without text give nothing.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    wanted = frozenset(("text",))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = machine.Placed()
        for page, scope, own, _, matrix, data, cuts in read_pages(batches):
            found = machine.Machine(matrix=matrix, scopes=own, flatten=flatten, kinds=wanted, placed=held)
            for _ in found.run(data, cuts, scope or 0):
                pass  # errors are rows of others
            held.end_page(*page)
            if held.n_glyphs >= BATCH_GLYPHS or len(held.seq) >= BATCH_GLYPHS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fold(held.finish()), arrow, strict=True)], schema=arrow)
                held = machine.Placed()
        if held.pages:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fold(held.finish()), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(of, schema)


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pages of :func:`folding`: (doc_id, page_index), scope, resources by scope, errors, matrix, decoded content and where further streams begin."""
    doc, named, scopes, streams = None, {}, {}, {}
    for batch in batches:
        held = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids, parts_of = held["doc_id"].to_pylist(), held["part"].to_pylist()

        def at(name: str, i: int, held=held):
            return held[name][i].as_py()

        for i, (doc_id, part) in enumerate(zip(ids, parts_of, strict=True)):
            if doc_id != doc:
                doc, named, scopes, streams = doc_id, {}, {}, {}
            if part == 0:
                named[at("res", i)] = at("named", i)
                continue
            if part == 1:
                streams[at("at", i)] = {"spec": at("spec", i), "raw": at("raw", i)}
                continue
            res, scope = at("res", i), at("scope", i)
            if res not in scopes:
                scopes[res] = scopes_of(named.pop(res, None))
            own, errors = scopes[res]
            data, cuts, error = joined_streams([streams[k] for k in at("contents", i) or () if k in streams])
            if scope:
                data = next((f.content for s in own.values() for f in s.forms.values() if f.scope == scope), b"")
            yield (doc_id, at("at", i)), scope, own, [*filter(None, (error, *errors))], tuple(at("matrix", i) or machine.IDENTITY), data, cuts


def scopes_of(resources: list[dict] | None) -> tuple[dict[int, machine.Scope], list[str]]:
    """Resources of a dictionary and its forms by scope, and what was wrong with forms that could not be read."""
    scopes: dict[int, machine.Scope] = {0: machine.Scope()}
    errors = []
    for r in resources or ():
        own = scopes.setdefault(r["scope"], machine.Scope())
        try:
            value = json.loads(r["spec"] or "{}")
            if r["category"] == "Font":
                own.fonts[r["name"]] = _font(
                    r["spec"], r["map_stream"], r["map_spec"], r["code_stream"], r["code_spec"],
                    tuple((x["spec"], x["stream"]) for x in r["parents"] or ()), tuple((x["glyph"], x["width"]) for x in r["procs"] or ()),
                )
            elif r["category"] == "Properties":
                own.properties[r["name"]] = value
            elif r["category"] == "ExtGState":
                own.states[r["name"]] = value
            elif value.get("Subtype") == "/Image":
                own.images.add(r["name"])
            else:
                matrix = value.get("Matrix") or machine.IDENTITY
                data = filters.decode(r["stream"] or b"", value, lenient=True)
                group = isinstance(value.get("Group"), dict) and value["Group"].get("S") == "/Transparency"
                own.forms[r["name"]] = machine.Form(r["obj"], data, tuple(map(float, matrix)), group)
        except filters.FilterIssue as e:
            errors.append(f"form {r['name']}: {e}")
        except (ValueError, TypeError, KeyError, AttributeError):
            continue  # a malformed resource is as good as a missing one
    return scopes, errors


@lru_cache(maxsize=512)
def _font(spec: str, map_stream: bytes | None, map_spec: str | None, code_stream: bytes | None, code_spec: str | None, parents: tuple, procs: tuple) -> fonts.Font:
    """A font; those of the pages before are kept, with the glyphs they have seen."""

    def decoded(stream, value):
        return filters.decode(stream, json.loads(value), lenient=True) if stream is not None else None

    try:
        below = tuple(decoded(stream, value) for value, stream in parents)
        return fonts.font_of(json.loads(spec), decoded(map_stream, map_spec), decoded(code_stream, code_spec), below, dict(procs))
    except (ValueError, TypeError, KeyError, AttributeError, IndexError):
        return fonts.Font()
