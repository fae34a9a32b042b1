import random

from pagequarry.sources import render
from pagequarry.streaming import ingest, revisions


def test_arriving_files_are_parsed_once(spark, tmp_path):
    inbox, out, checkpoint = (tmp_path / x for x in ("in", "out", "checkpoint"))
    inbox.mkdir()
    for k in range(2):
        (inbox / f"{k}.pdf").write_bytes(render.document([["a"]] * (k + 1), {}))
        ingest.ingest_objects(ingest.stream_files(spark, str(inbox)), str(out), str(checkpoint)).awaitTermination()
        objects = spark.read.parquet(str(out))
        assert objects.select("doc_id").distinct().count() == k + 1
        assert objects.where("error IS NOT NULL").count() == 0
    assert objects.count() == 8 + 10


def test_arrivals_are_counted_by_window(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pdf").write_bytes(b"%PDF-")
    q = ingest.arrivals(ingest.stream_files(spark, str(tmp_path))).writeStream.format("memory").queryName("arrivals").outputMode("complete")
    q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("arrivals").collect()
    assert sum(r.files for r in rows) == 3 and sum(r.bytes for r in rows) == 15


def test_revisions_over_a_stream_equal_the_batch_merge(spark, tmp_path):
    rng = random.Random(8)
    rows = [(d, o, at, 0, None if free else f"v{at}", free) for d in range(3) for o in range(12) for at in rng.sample(range(20), 6) for free in [rng.random() < 0.2]]
    rng.shuffle(rows)  # later revisions may arrive before earlier ones
    schema = "doc_id long, obj int, at long, gen int, value string, free boolean"
    seen = {}
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = revisions.current_versions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

        def take(batch, _):
            for r in batch.collect():
                seen[r.doc_id, r.obj] = tuple(r)

        changes.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        arrived = [r for j in range(k + 1) for r in rows[j::3]]
        want = {(r.doc_id, r.obj): tuple(r) for r in revisions.merged(spark.createDataFrame(arrived, schema)).collect()}
        assert seen == want
