"""Work is dealt to as many tasks as stated, rows that nobody reads are not made, and quick paths read what the plain ones read."""

import json

import pyarrow as pa

from pagequarry.kernels import document, syntax
from pagequarry.operators import security, tables
from pagequarry.sources import render, store, writer

SOUND = [
    b"<< /Type /Page /Kids [1 0 R [2 0 R]] /N -1.5 /S (a b) /H <41 4> /E (x\\)y) /B true /Z null /A#20B /C >>", b"[1 0 R 2 0 R 3 4 5 R]", b"12 0 R", b"-1 0 R", b"+3 0 R", b"(open", b"<< /A 1",
    b"<< 1 2 >>", b"[ >> ]", b"% c\n 5", b"[1 % c\n 2]", b"word", b"<< /A >>", b"<< /A word >>", b"5.", b"1 0 Rx", b"", b"[" * 60 + b"]" * 60,
]


def outcome(read):
    try:
        return read()
    except syntax.SyntaxIssue as e:
        return str(e)


def test_quick_reading_gives_what_token_by_token_reading_gives():
    for data in SOUND:
        slow, quick = syntax.Values(data), syntax.Values(data)
        found = outcome(lambda data=data: syntax.sound_value(data, 0))
        expected = outcome(lambda slow=slow: plain(slow))
        assert outcome(quick.read) == expected, data
        if isinstance(found, tuple):
            assert found == (expected, slow.at), data


def plain(values):
    original, syntax.sound_value = syntax.sound_value, lambda data, at: None
    try:
        return values.read()
    finally:
        syntax.sound_value = original


def test_rows_of_other_kinds_are_not_made():
    data = writer.revision(b"", {1: b"<< /Type /Catalog >>", 2: b"7"}, b"/Root 1 0 R", "table")
    every = list(document.read(data))
    assert {r["kind"] for r in every} == {"object", "section", "entry", "document"}
    for kind in ("object", "section", "entry", "document"):
        assert list(document.read(data, kinds=frozenset([kind]))) == [r for r in every if r["kind"] == kind]


def test_documents_are_rendered_in_the_stated_number_of_tasks(spark):
    docs = spark.createDataFrame([(i, "a b\nc", "s") for i in range(20)], "doc_id long, text string, source string").repartition(9)
    assert render.corpus_of(docs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counted_operations_are_those_of_the_pages(spark):
    content = spark.createDataFrame([(1, 0, b"BT (a) Tj 1 2 Td (b) Tj ET"), (1, 1, b"q Q (open"), (2, 0, None)], "doc_id long, page_index int, content binary")
    counted = {(r.doc_id, r.page_index, r.operator, r.n) for r in tables.operation_counts(content).collect()}
    listed = {tuple(r) for r in tables.operations(content).groupBy("doc_id", "page_index", "operator").count().collect()}
    assert counted == listed and (1, 0, "Tj", 2) in counted and (1, 1, None, 1) in counted


def test_a_table_of_a_few_megabytes_is_not_broadcast(spark):
    many = store.written(spark.range(150_000), "many")
    assert "BroadcastHashJoin" not in spark.range(10).join(many, "id")._jdf.queryExecution().toString()


def test_keys_are_found_in_the_stated_number_of_tasks(corpus):
    c = corpus(writer.revision(b"", {1: b"<< /Type /Catalog >>", 2: b"<< /Filter /Standard >>"}, b"/Root 1 0 R /Encrypt 2 0 R", "table"))
    assert "REPARTITION_BY_NUM" in security.unlocked(c.live, c.roots, "open")._jdf.queryExecution().toString()


def test_values_of_the_page_tree_are_read_once(corpus):
    tree, root, numbers = writer.page_tree(10, [b""] * 9)
    c = corpus(writer.revision(b"", {1: b"<< /Type /Catalog /Pages %d 0 R >>" % root, 2: b"<< /Kids (none) /Type /Other >>"} | tree, b"/Root 1 0 R", "table"))
    found = tables.pages(c.live, c.roots)
    assert [r.obj for r in found.orderBy("page_index").collect()] == numbers
    assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_values_by_their_shape_are_what_reading_by_tokens_gives():
    for data in [*SOUND, b"<< /A1 2 /A1 3 >>", b"<< /A 1 /A 2 >>", b"[-0 1]", b"[007 1]", b"[1 -5 +3]", b"<< /K [<< /Obj 12 0 R /Pg 3 0 R >> 7 0] /F1 2 >>", b"[1 0 R 5 3]", b"[]", b"<< >>", b"/a/b", b"<< /A true /B null >>"]:
        found = syntax.shaped(data) if syntax.simple(data, 0, len(data)) else None
        if found:
            slow = syntax.Values(data)
            assert found == (value := plain(slow), json.dumps(value)) and not data[slow.at :].strip(), data
    assert syntax.shaped(b"<< /Type /Page /Parent 3 0 R /F1 [4 -5] >>") == ({"Type": "/Page", "Parent": "3 0 R", "F1": [4, -5]}, '{"Type": "/Page", "Parent": "3 0 R", "F1": [4, -5]}')


def test_a_value_ends_where_its_object_does_and_an_object_stream_may_be_empty():
    data = b"%PDF-1.7\n1 0 obj /upstream endobj 2 0 obj << /A /x/endobj 1 >> endobj 3 0 obj 12\nendobj 4 0 obj << /Type /ObjStm /N 0 /First 0 /Length 0 >> stream\n\nendstream endobj 5 0 obj 7 endobj"
    rows = [r for r in document.read(data) if r["kind"] == "object"]
    assert [(r["obj"], r["value"]) for r in rows if r["obj"] != 4] == [(1, '"/upstream"'), (2, '{"A": "/x", "endobj": 1}'), (3, "12"), (5, "7")]
    assert not any(r["error"] for r in rows)


class Local:
    """Stands for a table: what would run in its tasks runs here."""

    def mapInArrow(self, of, schema):
        self.of = of
        return self


def test_batches_of_long_rows_are_bounded_by_what_they_hold(spark):
    long = tables.expanded(Local(), lambda d: iter([{"content": b"x" * (1 << 20)}]), "content binary")
    made = list(long.of([pa.record_batch({"k": list(range(20))})]))
    assert sum(b.num_rows for b in made) == 20 and max(b.num_rows for b in made) <= 5
    shown = b"BT " + b"(" + b"a" * 30_000 + b") Tj ET"
    empty, none = [None] * 6, [None]
    columns = {
        "doc_id": [1] * 7, "part": [1, *[2] * 6], "at": [3, *range(6)], "res": none + empty, "scope": none + [0] * 6, "matrix": pa.array(none + empty, pa.list_(pa.float64())), "contents": none + [[3]] * 6,
        "spec": ["{}", *empty], "raw": [shown, *empty], "named": none + empty,
    }
    runs = list(tables.interpreted(Local()).of([pa.record_batch(columns)]))
    assert sum(b.num_rows for b in runs) == 6 and max(b.num_rows for b in runs) <= 2


def test_without_content_pages_are_there_and_their_streams_are_not_written(spark):
    from pagequarry.plans.documents import Parsed

    made = render.document([["a"], ["b"]], {"Title": "t"})
    docs = spark.createDataFrame([(1, made)], "doc_id long, content binary")
    p = Parsed(docs, content=False)
    assert p.pages.count() == 2 and p.parts.where("stream IS NOT NULL").count() == 0 and p.objects.count() == 10


def test_entries_and_what_holds_objects_come_from_one_reading(spark, monkeypatch):
    from pagequarry.plans import structured

    calls = []
    made = writer.revision(b"", {1: b"<< /Type /Catalog >>", 10: b"7"}, b"/Root 1 0 R", "stream")
    docs = spark.createDataFrame([(1, made)], "doc_id long, content binary")
    monkeypatch.setattr(structured, "order_documents", lambda spark, sf_dir: calls.append(1) or docs)
    found = structured.pdf_newest_entries(spark, "")
    assert [tuple(r) for r in found.collect()] == [(1, 10, False)] and calls == [1]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
