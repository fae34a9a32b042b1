"""Documents as a Spark data source: ``spark.read.format("pagequarry").load(folder)`` gives the rows of the byte pass.

Files are listed when the scan is planned and dealt to partitions by size. Bytes are
read where they are parsed and never pass through the JVM. Conditions on ``path`` and
``kind`` are taken from the query (``spark.sql.python.filterPushdown.enabled``): files
whose path does not match are not opened, rows of other kinds are not made.

Options: ``path`` (file or folder, or a pattern), ``pages`` (zero-based, such as 0,2: the
content of others is left out), ``partitionBytes``, ``extension``. Stores that Arrow cannot
open are read by :func:`pagequarry.sources.render.read_files`, which uses Spark's own reader.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.kernels import document
from pagequarry.operators.tables import BATCH_BYTES, PARTS

SCHEMA = f"path string, {PARTS}"
BATCH = 2000
#: Bytes of files that a task reads: a megabyte of documents takes about a second.
PARTITION_BYTES = 4 << 20
KINDS = ("object", "section", "entry", "document")
#: Conditions that the scan can decide, by column.
DECIDED = {"path": (EqualTo, In, StringStartsWith, StringEndsWith, StringContains), "kind": (EqualTo, In)}


def document_id(path: str) -> int:
    """A document's number: the signed 64-bit hash of its path."""
    return int.from_bytes(xxhash.xxh64(path.encode()).digest(), "big", signed=True)


def holds(condition: Filter, value: str) -> bool:
    """Whether a value meets a pushed condition."""
    if isinstance(condition, In):
        return value in condition.value
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    if isinstance(condition, StringEndsWith):
        return value.endswith(condition.value)
    if isinstance(condition, StringContains):
        return condition.value in value
    return value == condition.value


class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options
        chosen = options.get("pages")
        self.pages = frozenset(int(p) for p in chosen.split(",")) if chosen else None
        self.conditions: dict[str, list[Filter]] = {c: [] for c in DECIDED}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, DECIDED.get(column, ())):
                self.conditions[column].append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(holds(f, value) for f in self.conditions[column])

    def partitions(self) -> Sequence[InputPartition]:
        path, limit = self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES))
        pattern = "*" in path
        root = path[: path.index("*")].rsplit("/", 1)[0] if pattern else path
        store, at = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"file:{root}")
        if store.get_file_info(at).type == fs.FileType.File:
            found = [store.get_file_info(at)]
        else:
            found = store.get_file_info(fs.FileSelector(at, recursive=True))
        suffix = self.options.get("extension", ".pdf")
        prefix = root[: len(root) - len(at)] if root.endswith(at) else ""
        listed = [(f.size or 0, prefix + f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)]
        listed = [(n, p) for n, p in listed if (not pattern or fnmatch.fnmatch(p, path)) and self._wanted("path", p)]
        out: list[Files] = []
        room = 0
        for n, p in sorted(listed, reverse=True):
            if not out or n > room:
                out.append(Files([]))
                room = limit
            out[-1].paths.append(p)
            room -= n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        arrow, held, room = to_arrow_schema(self.schema), [], BATCH_BYTES
        kinds = frozenset(k for k in KINDS if self._wanted("kind", k))
        stores: dict[str, tuple] = {}
        for path in partition.paths:
            folder, name = path.rsplit("/", 1)
            if folder not in stores:
                stores[folder] = fs.FileSystem.from_uri(folder)
            store, at = stores[folder][0], f"{stores[folder][1]}/{name}"
            with store.open_input_stream(at) as f:
                data = f.read()
            number = document_id(path)
            for row in document.read(data, self.pages, kinds):
                row["path"], row["doc_id"] = path, number
                held.append(row)
                room -= len(row.get("stream") or b"")
                if len(held) >= BATCH or room < 0:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, room = [], BATCH_BYTES
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


class PageSource(DataSource):
    """``format("pagequarry")``: path and the columns of :func:`pagequarry.operators.tables.parts`."""

    @classmethod
    def name(cls) -> str:
        return "pagequarry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let conditions reach its scans."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
