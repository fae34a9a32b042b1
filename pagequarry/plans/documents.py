"""Queries over documents rendered from the given tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import boxes, compare, images, layout, navigation, resources, tables, text
from pagequarry.sources import render, sinks
from pagequarry.sources.store import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Rendered corpora by application and folder.
RENDERED: dict[tuple, DataFrame] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` as a document with a page per line, rendered into the shared folder once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in RENDERED:
        RENDERED[key] = written(render.corpus_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "corpus")
    return RENDERED[key]


class Parsed:
    """The relations of a corpus; what several joins read is written once. Entries of sections are not among them (:func:`tables.parts` has them).

    With ``chosen`` page numbers the content of other pages is never written, moved or interpreted; without ``content``
    that of every page, while the pages themselves are there.
    """

    def __init__(self, docs: DataFrame, chosen: Collection[int] | None = None, content: bool = True) -> None:
        self.docs, self.chosen = docs, chosen
        self.parts = written(tables.parts(docs, chosen if content else (), ("object", "section", "document")), "parts")
        self.objects = tables.objects(self.parts)
        self.live = tables.current(self.objects)
        self.roots = tables.catalog(self.live, tables.states(self.parts))

    @cached_property
    def pages(self) -> DataFrame:
        return written(tables.pages(self.live, self.roots, self.chosen), "pages")

    @cached_property
    def shared(self) -> DataFrame:
        return resources.shared(self.live, self.pages)

    @cached_property
    def resources(self) -> DataFrame:
        return resources.on_pages(self.shared, self.pages)

    @cached_property
    def content(self) -> DataFrame:
        return tables.page_bytes(self.live, self.pages)

    def runs(
        self, flatten: bool = False, space: str = "default", kinds: Collection[str] | None = None, operators: Collection[str] | None = None, limit: int | None = None
    ) -> DataFrame:
        """The page machine's rows, placed in ``space`` (default, page or screen)."""
        page = resources.with_res(self.pages).withColumn("matrix", tables.page_matrix(space))
        rows = tables.folding(self.live, page, resources.dictionaries(self.live, self.shared))
        return tables.interpreted(rows, flatten, kinds, operators, limit)

    def placed(self, fold, schema: str, flatten: bool = False, space: str = "default") -> DataFrame:
        """What ``fold`` makes of the pages' shown text where it is read, as columns of ``schema``."""
        page = resources.with_res(self.pages).withColumn("matrix", tables.page_matrix(space))
        return tables.placed(tables.folding(self.live, page, resources.dictionaries(self.live, self.shared)), fold, schema, flatten)

    def form_runs(self, flatten: bool = False) -> DataFrame:
        """The rows of every form as a view of its own, in its own space; ``scope`` is the form."""
        rows = tables.folding(self.live, resources.form_pages(self.pages, self.shared), resources.dictionaries(self.live, self.shared))
        return tables.interpreted(rows, flatten)


LINES = r"WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), " \
    r"p AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS page_index, len(ls) AS n, unnest(ls) AS line FROM l), " \
    r"w AS (SELECT *, list_filter(string_split_regex(line, '[\s\x0B]+'), lambda x: x <> '') AS ws FROM p)"


@query(LINES + " SELECT doc_id, page_index, array_to_string([array_to_string(ws[r * 12 + 1 : r * 12 + 12], ' ') for r in range((len(ws) + 11) // 12)], chr(10)) AS text FROM w WHERE len(ws) > 0")
def pdf_text_round_trip(spark, sf_dir):
    """Rendered, read, interpreted and assembled again: every page's text."""
    return Parsed(corpus(spark, sf_dir)).placed(text.page_texts, text.PAGE_TEXT)


@query(LINES + " SELECT doc_id, array_to_string([array_to_string(ws[r * 12 + 1 : r * 12 + 12], ' ') for r in range((len(ws) + 11) // 12)], chr(10)) AS text FROM w WHERE len(ws) > 0 AND page_index = 0")
def pdf_first_pages(spark, sf_dir):
    """The text of every document's first page; no other page's content leaves the byte pass."""
    p = Parsed(corpus(spark, sf_dir), chosen=(0,))
    return text.untagged_text(p.runs(kinds=("text",))).select("doc_id", "text")


@query(LINES + " SELECT doc_id, page_index, ws[1] AS first, CASE WHEN len(ws) > 2 THEN ws[3] END AS third, least(len(ws), 3)::BIGINT AS n FROM w WHERE len(ws) > 0")
def pdf_first_words(spark, sf_dir):
    """The first three runs of every page; no page is read beyond them."""
    runs = Parsed(corpus(spark, sf_dir)).runs(kinds=("text",), operators=("Tj",), limit=3)
    said = runs.select("doc_id", "page_index", F.array_join(F.transform("glyphs", lambda g: g["text"]), "").alias("t"), F.row_number().over(text.page_order("seq")).alias("k"))
    return said.groupBy("doc_id", "page_index").agg(F.max(F.when(F.col("k") == 1, F.col("t"))).alias("first"), F.max(F.when(F.col("k") == 3, F.col("t"))).alias("third"), F.count(F.lit(1)).alias("n"))


@query(LINES + ", t AS (SELECT doc_id, sum(len(ws))::BIGINT AS n_words FROM w GROUP BY doc_id) SELECT lang, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words FROM t JOIN documents USING (doc_id) GROUP BY lang")
def pdf_words_by_lang(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = Parsed(corpus(spark, sf_dir)).placed(text.page_texts, text.PAGE_TEXT)
    words = pages.groupBy("doc_id").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)))).alias("n"))
    counted = docs.select("doc_id", "lang").join(words, "doc_id", "left")
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_words"))


@query("SELECT doc_id, (6 + 2 * n)::BIGINT AS n_objects, n::BIGINT AS n_streams, 0::BIGINT AS n_errors FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)")
def pdf_object_counts(spark, sf_dir):
    o = tables.objects(corpus(spark, sf_dir).select("doc_id", "content"))
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_objects"), F.count("stream").alias("n_streams"), F.count("error").alias("n_errors"))


@query(LINES + " SELECT doc_id, page_index, page_index + 1 AS page_number, 6 + 2 * page_index AS obj, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, CASE WHEN page_index < (n + 1) // 2 THEN 0 ELSE 90 END AS rotation FROM p")
def pdf_pages(spark, sf_dir):
    """The page tree's leaves with inherited boxes and rotation."""
    p = tables.page_geometry(Parsed(corpus(spark, sf_dir)).pages)
    return p.select("doc_id", "page_index", "page_number", "obj", "width", "height", "rotation")


@query("""WITH n AS (SELECT doc_id, 7 + 2 * len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
    SELECT doc_id, unnest(range(n))::INTEGER AS obj, unnest(range(n)) = 0 AS free, 0 AS rev, true AS found FROM n""")
def pdf_xref_entries(spark, sf_dir):
    """Cross-reference entries with whether the object is where they say."""
    found = written(tables.parts(corpus(spark, sf_dir)), "parts")
    objs = tables.objects(found).select("doc_id", "obj", F.col("offset").alias("at"))
    x = tables.xrefs(found).join(objs, ["doc_id", "obj"], "left")
    return x.select("doc_id", "obj", "free", F.col("rev").cast("int").alias("rev"), (F.col("free") | (F.col("at") == F.col("offset"))).alias("found"))


@query("SELECT doc_id, 'document ' || doc_id AS title, coalesce(source, '') AS subject, sha256(coalesce(source, '')) AS digest FROM documents")
def pdf_metadata(spark, sf_dir):
    p = Parsed(corpus(spark, sf_dir), content=False)
    info = navigation.information(p.live, p.roots)
    title, subject = F.col("info")["Title"], F.col("info")["Subject"]
    return info.select("doc_id", title.alias("title"), subject.alias("subject"), F.sha2(subject.cast("binary"), 256).alias("digest"))


@query(LINES + ", r AS (SELECT doc_id, len(ws) AS n, (len(ws) + 11) // 12 AS rows FROM w) SELECT doc_id, sum(n)::BIGINT AS shows, sum(greatest(rows - 1, 0))::BIGINT AS next_lines, sum(n + greatest(rows, 0) + 1)::BIGINT AS moves FROM r GROUP BY doc_id")
def pdf_operator_counts(spark, sf_dir):
    ops = tables.operation_counts(Parsed(corpus(spark, sf_dir)).content)

    def count(op: str, name: str):
        return F.sum(F.when(F.col("operator") == op, F.col("n")).otherwise(0)).alias(name)

    return ops.groupBy("doc_id").agg(count("Tj", "shows"), count("T*", "next_lines"), count("Td", "moves"))


@query(LINES + " SELECT doc_id, sum(len(array_to_string(ws, '')))::BIGINT AS n_glyphs, count(*) FILTER (len(ws) > 0) AS n_pages FROM w GROUP BY doc_id HAVING n_pages > 0")
def pdf_glyph_counts(spark, sf_dir):
    counted = Parsed(corpus(spark, sf_dir)).placed(sinks.page_counts, sinks.PAGE_COUNT)
    return counted.groupBy("doc_id").agg(F.sum("n_glyphs").alias("n_glyphs"), F.count(F.lit(1)).alias("n_pages"))


@query("""WITH n AS (SELECT count(*) AS d, sum(len(string_split(coalesce(text, ''), chr(10)))) AS p FROM documents),
    k AS (SELECT unnest(['number', 'keyword', 'open', 'close', 'name', '[', ']', 'string']) AS kind, unnest([54, 30, 9, 9, 35, 4, 4, 2]) AS a, unnest([15, 11, 2, 2, 7, 0, 0, 0]) AS b)
    SELECT kind, (a * d + b * p)::BIGINT AS n, CASE WHEN kind = 'number' THEN (a * d + b * p)::BIGINT ELSE 0 END AS n_numbers FROM k, n""")
def pdf_tokens_by_kind(spark, sf_dir):
    return tables.tokens(corpus(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("n_numbers"))




@query(LINES + ", e AS (SELECT doc_id, page_index, unnest(ws) AS text, unnest(range(1, len(ws) + 1))::INTEGER AS word FROM w) SELECT * FROM e")
def pdf_words(spark, sf_dir):
    """Words that the layout finds, in order."""
    found = Parsed(corpus(spark, sf_dir)).placed(layout.word_columns, layout.WORDS)
    return found.select("doc_id", "page_index", "text", "word")


@query(r"""SELECT conv_id AS doc_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')) AS words FROM conversations
    WHERE role <> 'assistant' GROUP BY conv_id HAVING words <> ''""")
def pdf_tagged_text(spark, sf_dir):
    """Each conversation as a tagged page, one section a turn and the assistant's turns as artifacts, read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tag = F.when(F.col("role") == "assistant", "Artifact").otherwise("P")
    docs = render.tagged_corpus_of(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), tag.alias("tag"), "text"))
    found = text.tagged_text(Parsed(docs).runs())
    return found.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("words"))


@query(LINES + ", b AS (SELECT doc_id, page_index, [array_to_string(ws[r * 12 + 1 : r * 12 + 12], ' ') for r in range((len(ws) + 11) // 12)] AS rows FROM w WHERE len(ws) > 0) SELECT doc_id, page_index, 0 AS box, len(rows)::BIGINT AS n_lines, array_to_string(rows, chr(10)) AS text FROM b")
def pdf_text_boxes(spark, sf_dir):
    """Boxes of neighbouring lines in reading order: rows that begin at one margin hang together."""
    lines = written(Parsed(corpus(spark, sf_dir)).placed(layout.line_columns, layout.LINES), "lines")
    return boxes.text_boxes(lines).select("doc_id", "page_index", "box", "n_lines", "text")


@query(LINES + " SELECT doc_id, page_index, sum(len(array_to_string(ws, '')))::BIGINT AS n, min(ws[1][1]) AS first FROM w WHERE len(ws) > 0 GROUP BY doc_id, page_index")
def pdf_glyph_rows(spark, sf_dir):
    """Glyphs as rows in paint order, counted, with the first of each page."""
    rows = Parsed(corpus(spark, sf_dir)).placed(sinks.glyph_columns, sinks.GLYPHS)
    return rows.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "index").alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'source' END AS \"column\", coalesce(source, '') AS expected, 'other' AS actual FROM documents WHERE doc_id % 10 = 0 AND coalesce(source, '') <> 'other'")
def pdf_differences(spark, sf_dir):
    """Metadata read back against the table, a tenth of which is changed first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"))
    changed = docs.withColumn("source", F.when(F.col("doc_id") % 10 == 0, "other").otherwise(F.col("source")))
    p = Parsed(corpus(spark, sf_dir), content=False)
    read = navigation.information(p.live, p.roots).select("doc_id", F.col("info")["Subject"].alias("source"))
    return compare.differences(read, changed, "doc_id")


@query("SELECT doc_id, 'Helvetica' AS name, 'Type1' AS kind, 'WinAnsiEncoding' AS encoding, false AS embedded FROM documents")
def pdf_fonts(spark, sf_dir):
    """Fonts of each document, by their own names; those of forms and of Type 3 fonts' own resources are among them."""
    p = Parsed(corpus(spark, sf_dir), content=False)
    return images.fonts(p.live, resources.on_pages(resources.shared(p.live, p.pages, drawn=True), p.pages)).select("doc_id", "name", "kind", "encoding", "embedded")
