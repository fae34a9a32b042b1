"""The data source and the table functions against the byte pass."""

import pytest

from pagequarry.functions import table_functions
from pagequarry.kernels import document
from pagequarry.operators import tables
from pagequarry.sources import datasource, render


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for k in range(6):
        (root / str(k % 2)).mkdir(exist_ok=True)
        (root / str(k % 2) / f"n-{k}.pdf").write_bytes(render.document([["page", str(p), str(k)] for p in range(k + 1)], {"Title": str(k)}))
    (root / "note.txt").write_bytes(b"no document")
    (root / "bad.pdf").write_bytes(b"")
    return root


def test_source_equals_the_byte_pass(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("pagequarry").option("partitionBytes", "2000").load(str(folder))
    assert rows.columns == ["path", *spark.createDataFrame([], tables.PARTS).columns]
    got = sorted((r.path.rsplit("/", 1)[1], r.kind, r.seq, r.obj, r.value) for r in rows.collect())
    want = []
    for path in folder.rglob("*.pdf"):
        want += [(path.name, r["kind"], r.get("seq"), r.get("obj"), r.get("value")) for r in document.read(path.read_bytes())]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert rows.rdd.getNumPartitions() > 2


def test_conditions_reach_the_scan(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("pagequarry").load(str(folder))
    found = rows.where("path LIKE '%/1/n-%' AND kind IN ('object', 'document') AND obj > 0")
    plan = found._jdf.queryExecution().toString()
    assert "StringContains" in plan or "PushedFilters" in plan or "path" in plan
    assert {r.path.rsplit("/", 1)[1] for r in found.select("path").distinct().collect()} == {"n-1.pdf", "n-3.pdf", "n-5.pdf"}
    reader = datasource.PageReader(datasource.StructType(), {"path": str(folder)})
    kept = list(reader.pushFilters([datasource.StringContains(("path",), "/1/"), datasource.EqualTo(("kind",), "object"), datasource.EqualTo(("obj",), 1)]))
    assert [f.attribute for f in kept] == [("obj",)]
    assert sorted(p for part in reader.partitions() for p in part.paths) == sorted(str(p) for p in (folder / "1").iterdir())


def test_pages_option_leaves_other_content_out(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("pagequarry").option("pages", "0,2").load(str(folder / "1" / "n-5.pdf")).where("shown AND live")
    assert rows.count() == 6 and rows.where("stream IS NOT NULL").count() == 2


def test_table_functions(spark):
    table_functions.register(spark)
    data = render.document([["a", "b"]], {})
    spark.createDataFrame([(1, data), (2, b"(open"), (3, None)], "doc_id long, content binary").createOrReplaceTempView("docs")
    objects = spark.sql("SELECT d.doc_id, o.obj, o.value FROM docs d, LATERAL pdf_objects(d.content) o ORDER BY doc_id, o.seq").collect()
    assert [(r.obj, r.value) for r in objects] == [(r["obj"], r["value"]) for r in document.read(data) if r["kind"] == "object"]
    every = spark.sql("SELECT d.doc_id, t.* FROM docs d, LATERAL pdf_tokens(d.content) t").collect()
    plain = tables.tokens(spark.table("docs")).collect()
    assert sorted((r.doc_id, r.seq, r.kind, r.text or "") for r in every) == sorted((r.doc_id, r.seq, r.kind, r.text or "") for r in plain)
    names = spark.sql("SELECT t.kind FROM docs d, LATERAL pdf_tokens(d.content, 'name') t WHERE t.kind <> 'error'").distinct().collect()
    assert [r.kind for r in names] == ["name"]
    ops = spark.sql("SELECT o.operator, o.error FROM (SELECT cast('q (a) Tj (b' AS binary) AS c) x, LATERAL pdf_operations(x.c, 'Tj') o").collect()
    assert [(r.operator, bool(r.error)) for r in ops] == [("Tj", False), (None, True)]
    table_functions.register_callback(spark, "pieces", lambda s: ((x, len(x)) for x in (s or "").split()), "piece string, n int")
    got = spark.sql("SELECT p.* FROM VALUES ('one three'), (NULL) t(s), LATERAL pieces(t.s) p").collect()
    assert [tuple(r) for r in got] == [("one", 3), ("three", 5)]
