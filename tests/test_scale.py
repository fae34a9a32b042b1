"""Plans that hold at size: what is broadcast, how work is dealt."""

from pyspark.sql import functions as F

from pagequarry.operators import trees
from pagequarry.sources import writer
from pagequarry.sources.store import written


def joined_plan(left, right) -> str:
    found = left.join(right, "doc_id")
    return found._jdf.queryExecution().executedPlan().toString()


def test_rows_that_repeat_are_not_broadcast_by_their_small_files(spark):
    alike = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("<< /Font 2 0 R >>"), 40).alias("value"))
    kept = written(alike, "alike")
    assert "Broadcast" not in joined_plan(kept.select("doc_id", "value"), kept.where("doc_id > 5").select("doc_id", F.length("value").alias("n")))
    assert "Broadcast" in joined_plan(written(alike.limit(20), "few"), written(alike.limit(20), "few"))


def test_levels_of_trees_are_not_broadcast(spark):
    nodes = spark.range(30_000).select(
        (F.col("id") % 10_000).alias("doc_id"), F.when(F.col("id") >= 10_000, 0).cast("int").alias("parent"), (F.col("id") / 10_000).cast("int").alias("node"),
        F.col("id").alias("ord"), F.lit("n").alias("name"), F.repeat(F.lit("x"), 500).alias("held"),
    )
    found = trees.walk(nodes, ["doc_id"], inherit=("held",))
    assert found.count() == 30_000
    assert "Broadcast" not in joined_plan(found, spark.range(1_000_000_000).withColumnRenamed("id", "doc_id"))


def test_few_small_rows_are_built_into_documents_by_as_many_tasks_as_stated(spark):
    rows = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.col("id").alias("ord"))
    made = writer.per_document(rows, lambda doc_id, own: b"%d" % len(own))
    assert made.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_calls_of_table_functions_make_no_arrow_batch_each(spark):
    from pyspark.util import PythonEvalType

    from pagequarry.functions import table_functions

    seen = {}

    class Registry:
        def register(self, name, f):
            seen[name] = f.evalType

    class Session:
        udtf = Registry()

    table_functions.register_callback(Session(), "own", lambda x: [(x,)], "x int")
    table_functions.register(Session())
    assert {seen[n] for n in ("own", "pdf_operations", "pdf_tokens")} == {PythonEvalType.SQL_TABLE_UDF}


def test_pages_of_lines_are_folded_in_as_many_tasks_as_stated_without_a_call_each(spark):
    from pagequarry.operators import boxes

    lines = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(1).alias("line"), F.when(F.col("id") == 7, "  ").otherwise("a").alias("text"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"),
    )
    found = boxes.box_lines(lines)
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tuple(r) for r in found.where("doc_id IN (6, 7)").collect()] == [(6, 0, 1, 0, 0)]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_runs_are_numbered_and_not_their_glyphs(spark):
    from pagequarry.sources import sinks

    glyph = "array<struct<text:string,x:double,y:double,dx:double,dy:double>>"
    g = [("a", 0.0, 0.0, 1.0, 0.0), ("b", 1.0, 0.0, 1.0, 0.0)]
    rows = [(1, 0, 5, "text", "F", 1.0, g), (1, 0, 2, "text", "F", 1.0, g[:1]), (1, 0, 3, "text", "F", 1.0, [])]
    runs = spark.createDataFrame(rows, f"doc_id long, page_index int, seq int, kind string, name string, size double, glyphs {glyph}")
    found = sinks.glyphs(runs)
    assert [(r["index"], r["text"]) for r in found.orderBy("index").collect()] == [(0, "a"), (1, "a"), (2, "b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_a_state_is_written_out_once_a_batch_and_common_operations_are_read_as_others():
    from pagequarry.kernels import content
    from pagequarry.operators import tables
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    data = b"BT /F1 10 Tf 12 TL(a b)Tj 1.5 -2 Td\n(c)  Tj%x\n7 0 Td(\\(d) Tj 1 2 3 Td [1] 0 d (e) Tjx (f"
    spaced = data.replace(b"Tj", b"%-\nTj").replace(b" Td", b"%-\nTd")  # comments keep the fast match away
    assert [o[:2] for o in content.operations(data)][:-1] == [o[:2] for o in content.operations(spaced)][:-1]
    for op, _, at in content.operations(data):
        assert op == "error" or data[at : at + len(op)] == op.encode()
    runs = tables.Runs(to_arrow_schema(StructType.fromDDL(tables.CONTENT)))
    for row in content.Machine().run(b"BT (a) Tj (b) Tj 2 w (c) Tj"):
        runs.add(1, 0, row)
    assert len(runs.state["line"]) == 2
    assert [x["width"] for x in runs.batch().column("line").to_pylist()] == [1.0, 1.0, 2.0]
