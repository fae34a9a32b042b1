import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", folder)
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Corpus:
    """The relations of documents given as bytes."""

    def __init__(self, spark, *contents):
        from pagequarry.operators import resources, tables

        df = spark.createDataFrame([(i + 1, c) for i, c in enumerate(contents)], "doc_id long, content binary")
        self.parts = tables.parts(df).cache()
        self.live = tables.current(tables.objects(self.parts)).cache()
        self.roots = tables.catalog(self.live, tables.states(self.parts)).cache()
        self.pages = tables.pages(self.live, self.roots).cache()
        self.shared = resources.shared(self.live, self.pages)
        self.resources = resources.on_pages(self.shared, self.pages)

    def runs(self, flatten=False):
        from pagequarry.operators import resources, tables

        rows = tables.folding(self.live, resources.with_res(self.pages).withColumn("matrix", tables.page_matrix("default")), resources.dictionaries(self.live, self.shared))
        return tables.interpreted(rows, flatten)


@pytest.fixture(scope="session")
def corpus(spark):
    return lambda *contents: Corpus(spark, *contents)
