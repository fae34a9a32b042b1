"""Documents written from numbered object bodies: tables or streams of entries, packed objects, later revisions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def escaped(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def text_string(value: str | None) -> bytes:
    """A string object: plain where Latin letters do, else UTF-16 with its mark."""
    value = value or ""
    if value.isascii():
        return escaped(value.encode())
    return b"<FEFF" + value.encode("utf-16-be").hex().upper().encode() + b">"


def stream(data: bytes, entries: bytes = b"", compress: bool = True) -> bytes:
    """Body of a stream object."""
    if compress:
        data, entries = zlib.compress(data, 1), entries + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), entries.strip(), data)


def refs(numbers) -> bytes:
    return b"[" + b" ".join(b"%d 0 R" % n for n in numbers) + b"]"


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """(first, count) of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][0] + out[-1][1] == n:
            out[-1] = out[-1][0], out[-1][1] + 1
        else:
            out.append((n, 1))
    return out


def revision(before: bytes, bodies: dict[int, bytes], trailer: bytes, style: str = "table", freed: tuple[int, ...] = (), prev: int | None = None, above: int = 0) -> bytes:
    """``before`` with the objects appended and listed; ``style`` is table, stream (objects without streams are packed) or hybrid.

    ``above`` is the highest number that earlier revisions use.
    """
    out = bytearray(before or b"%PDF-1.7\n")
    size = max([*bodies, *freed], default=0)
    size = max(size, above) + 3
    inner = {k for k, v in bodies.items() if b"stream\n" not in v} if style != "table" else set()
    rows: dict[int, tuple[int, int, int]] = {k: (0, 0, 0) for k in freed}
    if not before:
        rows[0] = 0, 0, 65535
    for k in sorted(set(bodies) - inner):
        rows[k] = 1, len(out), 0
        out += b"%d 0 obj\n%s\nendobj\n" % (k, bodies[k])
    if inner:
        head, body = [], bytearray()
        for i, k in enumerate(sorted(inner)):
            head.append(b"%d %d" % (k, len(body)))
            body += bodies[k] + b"\n"
            rows[k] = 2, size - 2, i
        heads = b" ".join(head) + b"\n"
        rows[size - 2] = 1, len(out), 0
        out += b"%d 0 obj\n%s\nendobj\n" % (size - 2, stream(heads + bytes(body), b"/Type /ObjStm /N %d /First %d" % (len(head), len(heads))))
    known = b"/Size %d %s" % (size, trailer) + (b" /Prev %d" % prev if prev is not None else b"")

    def entries_stream(chosen: list[int], extra: bytes) -> None:
        index = b" ".join(b"%d %d" % r for r in _ranges(chosen))
        raw = b"".join(bytes([rows[k][0]]) + rows[k][1].to_bytes(5, "big") + rows[k][2].to_bytes(2, "big") for k in chosen)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (size - 1, stream(raw, b"/Type /XRef /W [1 5 2] /Index [%s] %s" % (index, extra))))

    start = len(out)
    if style == "stream":
        rows[size - 1] = 1, start, 0
        entries_stream(sorted(rows), known)
    else:
        if style == "hybrid":
            entries_stream(sorted(k for k in rows if rows[k][0] == 2), b"/Size %d" % size)
            known += b" /XRefStm %d" % start
            start = len(out)
        out += b"xref\n"
        plain = sorted(k for k in rows if rows[k][0] != 2)
        for first, n in _ranges(plain):
            out += b"%d %d\n" % (first, n)
            out += b"".join(b"%010d %05d %c \n" % (rows[k][1], rows[k][2], b"fn"[rows[k][0]]) for k in range(first, first + n))
        out += b"trailer\n<< %s >>\n" % known
    out += b"startxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def last_start(data: bytes) -> int:
    """Offset of the newest section."""
    return int(data[data.rfind(b"startxref") + 9 :].split()[0])


def per_document(rows: DataFrame, build: Callable[[int, list[dict]], bytes], order: str = "ord") -> DataFrame:
    """doc_id and content: ``build`` of each document's rows in order; a document's rows meet in one place, as its bytes must."""
    others = [c for c in rows.columns if c not in ("doc_id", order)]
    packed = F.sort_array(F.collect_list(F.struct(order, *others))).alias("rows")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("rows")
            for at in range(0, batch.num_rows, 64):
                own = lists.slice(at, 64)
                some = range(len(own))
                held = own.flatten()
                names = [f.name for f in held.type]
                dicts = [dict(zip(names, r, strict=True)) for r in zip(*[c.to_pylist() for c in held.flatten()], strict=True)]
                ends = [0, *accumulate(own.value_lengths().to_pylist())]
                made = [build(i, dicts[ends[k] : ends[k + 1]]) for k, i in enumerate(ids.slice(at, 64).to_pylist())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(made, pa.binary())], names=["doc_id", "content"])

    # rows are small in bytes and documents costly to make and read: the number of partitions is stated, so that few bytes do not end in few tasks
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.withColumn("doc_id", F.col("doc_id").cast("long")).repartition(slots, "doc_id").groupBy("doc_id").agg(packed)
    return grouped.mapInArrow(of, "doc_id long, content binary")


def page_tree(first: int, pages: list[bytes], extra: bytes = b"", fan: int = 8) -> tuple[dict[int, bytes], int, list[int]]:
    """Bodies of a page tree from object ``first`` on, its root and the numbers of the pages; ``fan`` kids a node."""
    bodies, numbers, at = {}, [], first
    last = first + len(pages)  # pages come first
    level = []
    for attributes in pages:
        bodies[at] = attributes
        numbers.append(at)
        level.append((at, 1))
        at += 1
    parents: dict[int, int] = {}
    while len(level) > 1 or not level or level[0][0] < last:
        above = []
        for i in range(0, max(len(level), 1), fan):
            kids = level[i : i + fan]
            for k, _ in kids:
                parents[k] = at
            count = sum(n for _, n in kids)
            bodies[at] = b"<< /Type /Pages /Kids %s /Count %d" % (refs(k for k, _ in kids), count)
            above.append((at, count))
            at += 1
        level = above
    root = level[0][0]
    for k, body in list(bodies.items()):
        parent = b" /Parent %d 0 R" % parents[k] if k in parents else b" /MediaBox [0 0 595 842] " + extra
        bodies[k] = (b"<< /Type /Page " + body if k < last else body) + parent + b" >>"
    return bodies, root, numbers


def json_value(value: object) -> bytes:
    """A JSON-like value as an object: strings that begin with a slash are names, ``n 0 R`` references."""
    kind = type(value)
    if kind is str:
        reference = value.endswith(" 0 R") and value[:-4].isdigit()
        return value.encode() if value.startswith("/") or reference else text_string(value)
    if kind is int:
        return b"%d" % value
    if kind is list:
        return b"[" + b" ".join([json_value(v) for v in value]) + b"]"
    if kind is dict:
        return b"<< " + b" ".join([b"/%s %s" % (k.encode(), json_value(v)) for k, v in value.items()]) + b" >>"
    return json.dumps(value).encode()
