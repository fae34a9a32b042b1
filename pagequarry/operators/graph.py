"""References between objects as a graph: edges, what is reachable from where, and the links of annotations and outlines.

A reference can only stand in a value as the JSON string ``"n g R"``, so the edges
of every value come out of one expression. A search needs a document's edges
alone, which came from one document's bytes: each document is searched breadth
first in one step, however long its chains are (an outline of a thousand siblings
is a chain of a thousand), and documents run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.navigation import items, resolved
from pagequarry.operators.tables import field, ref

REFERENCE = r'(?:^|")([0-9]+) [0-9]+ R(?="|$)'


def edges(live: DataFrame) -> DataFrame:
    """Every reference of every current value: doc_id, src, key (its dictionary's key at the top, else null), place (in that value), dst."""
    own = live.select("doc_id", F.col("obj").alias("src"), "value")
    keyed = own.where(F.col("value").startswith("{")).select("doc_id", "src", F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    plain = own.where(F.col("value").startswith("[") | F.col("value").startswith('"')).select("doc_id", "src", F.lit(None).cast("string").alias("key"), F.col("value").alias("v"))
    found = F.regexp_extract_all("v", F.lit(REFERENCE), F.lit(1))
    return keyed.unionByName(plain).select("doc_id", "src", "key", F.posexplode(found).alias("place", "dst")).withColumn("dst", F.col("dst").cast("int"))


def referrers(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges that lead to the (doc_id, obj) rows of ``wanted``."""
    return links.join(wanted.select("doc_id", F.col("obj").alias("dst")).distinct(), ["doc_id", "dst"], "left_semi")


def trailer_objects(roots: DataFrame) -> DataFrame:
    """doc_id and the object numbers that a document's trailer names."""
    named = F.explode(F.from_json("trailer", "map<string,string>")).alias("key", "v")
    found = roots.select("doc_id", named).select("doc_id", F.explode(F.regexp_extract_all("v", F.lit(REFERENCE), F.lit(1))).alias("obj"))
    return found.select("doc_id", F.col("obj").cast("int").alias("obj"))


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, obj and ``steps`` of every object that the (doc_id, obj) rows of ``starts`` lead to, themselves at 0 steps."""
    outgoing = links.groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    begun = starts.where("obj IS NOT NULL").groupBy("doc_id").agg(F.collect_set("obj").alias("starts"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, first, listed in zip(*[batch.column(c) for c in ("doc_id", "starts", "edges")], strict=True):
                following: dict[int, list[int]] = {}
                if listed.is_valid:
                    pairs = listed.values
                    for a, b in zip(pairs.field("src").to_pylist(), pairs.field("dst").to_pylist(), strict=True):
                        following.setdefault(a, []).append(b)
                steps = dict.fromkeys(first.as_py(), 0)
                level = list(steps)
                while level:
                    after = {b for a in level for b in following.get(a, ()) if b not in steps}
                    steps |= dict.fromkeys(after, steps[level[0]] + 1)
                    level = list(after)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * len(steps), pa.int64()), pa.array(list(steps), pa.int32()), pa.array(list(steps.values()), pa.int32())], names=["doc_id", "obj", "steps"]
                )

    return begun.join(outgoing, "doc_id", "left").mapInArrow(of, "doc_id long, obj int, steps int")


def unreachable(live: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Current objects that nothing leads to from the trailer; streams of objects and entries do not count."""
    found = reachable(links, trailer_objects(roots)).select("doc_id", "obj")
    own = live.where(~F.coalesce(field("value", "Type").isin("/ObjStm", "/XRef"), F.lit(False)))
    return own.join(found, ["doc_id", "obj"], "left_anti").select("doc_id", "obj", "value")


#: Keys of an annotation that name another object, and what they link to.
ANNOTATION_LINKS = {"Popup": "popup", "Parent": "parent", "IRT": "reply_to", "P": "page"}


def annotation_objects(live: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations that are objects of their own: doc_id, page_index, seq, obj."""
    listed = resolved(pages.select("doc_id", "page_index", field("value", "Annots").alias("a")), live, "a").where("a IS NOT NULL")
    each = listed.select("doc_id", "page_index", F.posexplode(items(F.col("a"))).alias("seq", "v"))
    return each.select("doc_id", "page_index", "seq", ref(F.col("v")).alias("obj")).where("obj IS NOT NULL")


def object_elements(live: DataFrame) -> DataFrame:
    """Structure elements that hold an object by reference: doc_id, node, obj and the page that the reference states."""
    kids = live.where(field("value", "S").isNotNull()).select("doc_id", F.col("obj").alias("node"), field("value", "K").alias("k")).where("k IS NOT NULL")
    each = kids.select("doc_id", "node", F.explode(F.when(F.col("k").startswith("["), items(F.col("k"))).otherwise(F.array("k"))).alias("k"))
    each = resolved(each, live, "k").where(field("k", "Type") == "/OBJR")
    return each.select("doc_id", "node", ref(field("k", "Obj")).alias("obj"), ref(field("k", "Pg")).alias("page_obj"))


def annotation_links(live: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """What annotations lead to: doc_id, page_index, seq, obj, link (popup, parent, reply_to, page, element, replies) and target object."""
    own = annotation_objects(live, pages)
    kind = F.create_map(*[F.lit(x) for pair in ANNOTATION_LINKS.items() for x in pair])[F.col("key")]
    direct = links.where(F.col("key").isin(*ANNOTATION_LINKS)).select("doc_id", F.col("src").alias("obj"), kind.alias("link"), F.col("dst").alias("target"))
    replies = links.where("key = 'IRT'").select("doc_id", F.col("dst").alias("obj"), F.lit("reply").alias("link"), F.col("src").alias("target"))
    elements = object_elements(live).select("doc_id", "obj", F.lit("element").alias("link"), F.col("node").alias("target"))
    return own.join(direct.unionByName(replies).unionByName(elements), ["doc_id", "obj"])


def outline_elements(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Structure elements that outline items (doc_id, node) name: doc_id, node, element."""
    named = links.where("key = 'SE'").select("doc_id", F.col("src").alias("node"), F.col("dst").alias("element"))
    return nodes.select("doc_id", "node").join(named, ["doc_id", "node"])
