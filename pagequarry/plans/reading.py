"""Queries that read documents by the library's own data source and by table functions in SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import table_functions
from pagequarry.operators import tables
from pagequarry.plans.documents import Parsed, corpus
from pagequarry.sources import datasource
from pagequarry.sources.store import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Folders of files by application and table folder.
FILES: dict[tuple, str] = {}


def query(sql: str):
    """Register a query under its function's name with its DuckDB equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def files_of(docs: DataFrame, folder: str) -> None:
    """Each document of a corpus as a file ``n-<doc_id>.pdf`` below a folder that all executors share, in a folder for each last digit."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        there: set[int] = set()
        for batch in batches:
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                if i % 10 not in there:
                    store.create_dir(f"{at}/{i % 10}", recursive=True)
                    there.add(i % 10)
                with store.open_output_stream(f"{at}/{i % 10}/n-{i}.pdf") as f:
                    f.write(data.as_py())
            yield batch.select(["doc_id"])

    docs.select("doc_id", "content").mapInArrow(of, "doc_id long").write.format("noop").mode("overwrite").save()


def files(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in FILES:
        FILES[key] = f"{shared_dir(spark)}/files-{len(FILES)}"
        files_of(corpus(spark, sf_dir), FILES[key])
    return FILES[key]


def file_number(path):
    return F.regexp_extract(path, r"n-(-?\d+)\.pdf$", 1).cast("long")


@query("SELECT doc_id, n::BIGINT AS n_streams, (2 * n + 6)::BIGINT AS n_objects FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE doc_id % 10 = 7)")
def pdf_source_objects(spark, sf_dir):
    """Objects of the documents in one folder of ten, by the library's format: other files are not opened, other kinds of rows not made."""
    datasource.register(spark)
    read = spark.read.format("pagequarry").load(files(spark, sf_dir))
    found = read.where(F.col("path").contains("/7/n-") & (F.col("kind") == "object"))
    return found.groupBy(file_number("path").alias("doc_id")).agg(F.count("stream").alias("n_streams"), F.count(F.lit(1)).alias("n_objects"))


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_pages, 1::BIGINT AS n_shown FROM documents")
def pdf_source_first_pages(spark, sf_dir):
    """Pages of every file, of which only the first one's content was read."""
    datasource.register(spark)
    parts = spark.read.format("pagequarry").option("pages", "0").load(files(spark, sf_dir))
    objects = parts.where("kind = 'object' AND live")
    shown = F.sum(F.when(F.col("shown") & F.col("stream").isNotNull(), 1).otherwise(0)).alias("n_shown")
    pages = F.sum(F.when(tables.field("value", "Type") == "/Page", 1).otherwise(0)).alias("n_pages")
    return objects.groupBy(file_number("path").alias("doc_id")).agg(pages, shown)


@query("""WITH n AS (SELECT count(*) AS d, sum(len(string_split(coalesce(text, ''), chr(10)))) AS p FROM documents),
    k AS (SELECT unnest(['number', 'name', 'string']) AS kind, unnest([54, 35, 2]) AS a, unnest([15, 7, 0]) AS b)
    SELECT kind, (a * d + b * p)::BIGINT AS n FROM k, n""")
def pdf_sql_tokens(spark, sf_dir):
    """Tokens of chosen kinds by a table function in SQL text."""
    table_functions.register(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("pagequarry_corpus")
    return spark.sql("SELECT t.kind, count(*) AS n FROM pagequarry_corpus d, LATERAL pdf_tokens(d.content, 'number,name,string') t GROUP BY t.kind")


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line FROM l),
    w AS (SELECT doc_id, list_filter(string_split_regex(line, '[\s\x0B]+'), lambda x: x <> '') AS ws FROM p)
    SELECT doc_id, sum(len(ws))::BIGINT AS shows, max(coalesce(list_max([length(x) for x in ws]), 0))::BIGINT AS longest FROM w GROUP BY doc_id HAVING shows > 0""")
def pdf_sql_operations(spark, sf_dir):
    """Show operations of every page's content by a table function, measured by one of the user's own."""
    table_functions.register(spark)

    def measured(operands: str) -> Iterator[tuple]:
        yield (sum(len(x) // 2 - 1 for x in json.loads(operands)),)

    table_functions.register_callback(spark, "pagequarry_measured", measured, "n int")
    Parsed(corpus(spark, sf_dir)).content.createOrReplaceTempView("pagequarry_content")
    return spark.sql("""SELECT c.doc_id, count(*) AS shows, max(cast(m.n AS long)) AS longest
        FROM pagequarry_content c, LATERAL pdf_operations(c.content, 'Tj') o, LATERAL pagequarry_measured(o.operands) m GROUP BY c.doc_id""")
