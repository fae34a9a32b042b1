"""Logical structure: elements, their marked contents, the parent tree and element text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import sequences, trees
from pagequarry.operators.navigation import items, number_tree, resolved, text_value
from pagequarry.operators.tables import field, ref
from pagequarry.sources.store import written

INHERITED = ("page_obj",)


def elements(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Structure elements depth first: doc_id, node, parent, depth, dfs_index, role, raw_role, page_obj, title, lang, alt, actual_text, outer (node and text of the topmost ActualText above or at it).

    Elements are indirect objects; one on a cycle, or that no parent lists, is not reached.
    """
    tree = resolved(roots.select("doc_id", field("catalog", "StructTreeRoot").alias("t")), live, "t").where("t IS NOT NULL")
    roles = resolved(tree.select("doc_id", field("t", "RoleMap").alias("m")), live, "m").select("doc_id", F.from_json("m", "map<string,string>").alias("roles"))
    tops = tree.select("doc_id", F.lit(None).cast("int").alias("parent"), field("t", "K").alias("k"))
    inner = live.where(field("value", "S").isNotNull()).select("doc_id", F.col("obj").alias("parent"), field("value", "K").alias("k"))
    listed = F.when(F.col("k").startswith("["), items(F.col("k"))).otherwise(F.array("k"))
    kids = tops.unionByName(inner).where("k IS NOT NULL").select("doc_id", "parent", F.posexplode(listed).alias("ord", "kid"))
    edges = kids.select("doc_id", "parent", F.col("ord").cast("long").alias("ord"), ref(F.col("kid")).alias("node")).where("node IS NOT NULL")
    values = live.where(field("value", "S").isNotNull()).select(
        "doc_id", F.col("obj").alias("node"), F.lit("").alias("name"), ref(field("value", "Pg")).alias("page_obj"), F.substring(field("value", "S"), 2, 2**30).alias("raw_role"),
        *[text_value(field("value", k)).alias(c) for k, c in (("T", "title"), ("Lang", "lang"), ("Alt", "alt"), ("ActualText", "actual_text"))],
    )
    outer = F.when(F.col("actual_text").isNotNull(), F.struct("node", F.col("actual_text").alias("text"))).alias("outer")
    linked = written(edges.join(values.select("doc_id", "node", "name", "page_obj", outer), ["doc_id", "node"]), "structure")
    reached = trees.walk(linked, ["doc_id"], inherit=INHERITED, outer=("outer",))
    dfs = F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1
    named = reached.withColumn("dfs_index", dfs).join(values.drop("name", "page_obj"), ["doc_id", "node"]).join(roles, "doc_id", "left")
    role = F.coalesce(F.substring(F.col("roles")[F.col("raw_role")], 2, 2**30), "raw_role")
    return named.select("doc_id", "node", "parent", "depth", "dfs_index", role.alias("role"), "raw_role", "page_obj", "title", "lang", "alt", "actual_text", "outer")


def find(elems: DataFrame, role: str, first: bool = False) -> DataFrame:
    """Elements of a role depth first; of each document only the ``first`` one if so asked."""
    found = elems.where(F.col("role") == role)
    return sequences.one_per(found, ["doc_id"], ["dfs_index"]) if first else found


def mcid_index(content: DataFrame, elems: DataFrame, pages: DataFrame) -> DataFrame:
    """Every content id of a document with its page and element; ids repeat from page to page."""
    placed = content.join(pages.select("doc_id", "page_index", F.col("obj").alias("page_obj")), ["doc_id", "page_obj"])
    return placed.join(elems.select("doc_id", "node", "role", "dfs_index"), ["doc_id", "node"]).select("doc_id", "page_index", "mcid", "node", "role", "dfs_index", "ord")


def logical_ranks(content: DataFrame, elems: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_index, mcid and rank of the page's contents in the order of the structure; pages where an id repeats are left out."""
    index = mcid_index(content, elems, pages)
    page = ["doc_id", "page_index"]
    ranked = index.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy("dfs_index", "ord")))
    unclear = index.groupBy(*page, "mcid").count().where("count > 1").select(*page).distinct()
    return ranked.join(unclear, page, "left_anti").select(*page, "mcid", "rank")


def content_parents(runs: DataFrame, slots: DataFrame) -> DataFrame:
    """``runs`` with the element (``node``) that their innermost marked content belongs to."""
    top = F.element_at("marked", -1)["mcid"]
    own = slots.select("doc_id", "page_index", F.col("mcid").alias("_mcid"), "node")
    return runs.withColumn("_mcid", top).join(own, ["doc_id", "page_index", "_mcid"], "left").drop("_mcid")


def element_boxes(elems: DataFrame, content: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, node and bbox: around all text, paths and images of an element's contents; forms do not count."""
    ends = F.transform("glyphs", lambda g: g["x"] + g["dx"])
    xs = F.concat(F.transform("glyphs", lambda g: g["x"]), ends)
    said = F.when((F.col("kind") == "text") & (F.size("glyphs") > 0), F.array(F.array_min(xs), F.col("y"), F.array_max(xs), F.col("y") + F.col("size")))
    boxed = runs.where("kind IN ('text', 'path', 'image')").select("doc_id", "page_index", F.element_at("marked", -1)["mcid"].alias("mcid"), F.coalesce(said, "bbox").alias("r"))
    index = mcid_index(content, elems, pages).select("doc_id", "page_index", "mcid", "node")
    r = F.col("r")
    return index.join(boxed.where("r IS NOT NULL"), ["doc_id", "page_index", "mcid"]).groupBy("doc_id", "node").agg(
        F.array(F.min(r[0]), F.min(r[1]), F.max(r[2]), F.max(r[3])).alias("bbox")
    )


def declared_boxes(live: DataFrame, elems: DataFrame) -> DataFrame:
    """doc_id, node and bbox that an element's attributes state (of several objects the first with a box of four numbers)."""
    held = elems.select("doc_id", "node").join(live.select("doc_id", F.col("obj").alias("node"), field("value", "A").alias("a")), ["doc_id", "node"])
    listed = F.when(F.col("a").startswith("["), items(F.col("a"))).otherwise(F.array("a"))
    each = held.where("a IS NOT NULL").select("doc_id", "node", F.posexplode(listed).alias("place", "attribute"))
    box = F.from_json(field("attribute", "BBox"), "array<double>")
    stated = resolved(each, live, "attribute").withColumn("bbox", box).where((F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull()))
    return stated.groupBy("doc_id", "node").agg(F.min_by("bbox", "place").alias("bbox"))


def boxes(live: DataFrame, elems: DataFrame, content: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, node and bbox of elements: as their attributes state it, else around their contents."""
    stated = declared_boxes(live, elems)
    return stated.unionByName(element_boxes(elems, content, pages, runs).join(stated, ["doc_id", "node"], "left_anti"))


def contents(live: DataFrame, elems: DataFrame) -> DataFrame:
    """Marked contents of elements in order: doc_id, node, ord, page_obj, mcid; a content's own page wins over its element's."""
    kids = live.select("doc_id", F.col("obj").alias("node"), field("value", "K").alias("k"))
    listed = F.when(F.col("k").startswith("["), items(F.col("k"))).otherwise(F.array("k"))
    each = elems.select("doc_id", "node", "page_obj").join(kids.where("k IS NOT NULL"), ["doc_id", "node"])
    each = each.select("doc_id", "node", "page_obj", F.posexplode(listed).alias("ord", "kid"))
    reference = field("kid", "MCID").isNotNull() & F.col("kid").startswith("{")
    mcid = F.when(reference, field("kid", "MCID")).otherwise(F.col("kid")).try_cast("int")
    own = F.when(reference, ref(field("kid", "Pg")))
    return each.select("doc_id", "node", "ord", F.coalesce(own, "page_obj").alias("page_obj"), mcid.alias("mcid")).where("mcid IS NOT NULL")


def parent_slots(live: DataFrame, roots: DataFrame, pages: DataFrame) -> DataFrame:
    """Slots of each page's parent-tree array, null ones included: doc_id, page_index, mcid, node."""
    tree = resolved(roots.select("doc_id", field("catalog", "StructTreeRoot").alias("t")), live, "t")
    starts = tree.select("doc_id", ref(field("t", "ParentTree")).alias("node")).where("node IS NOT NULL")
    slots = resolved(number_tree(live, starts), live, "value")
    keyed = pages.select("doc_id", "page_index", field("value", "StructParents").try_cast("int").alias("key")).where("key IS NOT NULL")
    return keyed.join(slots, ["doc_id", "key"]).select("doc_id", "page_index", F.posexplode(items(F.col("value"))).alias("mcid", "slot")).select(
        "doc_id", "page_index", "mcid", ref(F.col("slot")).alias("node")
    )


def element_text(elems: DataFrame, content: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, node and text: ActualText, else the text of the element's contents in order, without soft hyphens."""
    top = F.element_at("marked", -1)
    said = F.array_join(F.transform("glyphs", lambda g: g["text"]), "")
    shown = runs.where("kind = 'text'").select("doc_id", "page_index", "seq", top["mcid"].alias("mcid"), F.coalesce(text_value(top["actual"]), said).alias("piece"))
    placed = content.join(pages.select("doc_id", "page_index", F.col("obj").alias("page_obj")), ["doc_id", "page_obj"]).join(shown, ["doc_id", "page_index", "mcid"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "page_index", "seq", "piece"))), lambda p: p["piece"]), "")
    own = placed.groupBy("doc_id", "node").agg(joined.alias("joined"))
    text = F.replace(F.coalesce("actual_text", "joined", F.lit("")), F.lit("­"), F.lit(""))
    return elems.join(own, ["doc_id", "node"], "left").select("doc_id", "node", text.alias("text"))


def actual_texts(content: DataFrame, elems: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_index, mcid and ``outer`` (node and text) of the contents whose element, or one above it, has an ActualText."""
    index = mcid_index(content, elems, pages)
    return index.join(elems.select("doc_id", "node", "outer"), ["doc_id", "node"]).where("outer IS NOT NULL").select("doc_id", "page_index", "mcid", "outer")
