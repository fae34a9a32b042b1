"""Rows of a table as page-description documents, for fixtures and round trips."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.kernels.fonts import standard_width
from pagequarry.sources.writer import escaped, per_document

SIZE, LEADING, WORDS_PER_ROW = 10.0, 12.0, 12
MARGIN = 36.0


#: Widths of the renderer's font by the byte of a character.
WIDTHS = [standard_width("", bytes([b]).decode("cp1252", "replace")) for b in range(256)]


class Shown(dict):
    """Words met before: the operation that shows a word and the one that moves behind it, and how far that is."""

    MOST = 200_000

    def __missing__(self, word: str) -> tuple[bytes, float]:
        raw = word.encode("cp1252", "replace")
        step = round((sum(map(WIDTHS.__getitem__, raw)) + 278) * SIZE / 1000, 4)
        if len(self) >= self.MOST:
            self.clear()
        made = self[word] = escaped(raw) + b" Tj\n%g 0 Td" % step, step
        return made


SHOWN = Shown()


def page_content(words: list[str]) -> bytes:
    """Words in rows of ``WORDS_PER_ROW``, each shown on its own, one space apart."""
    out = [b"BT /F1 %g Tf %g TL %g 800 Td" % (SIZE, LEADING, MARGIN)]
    met = list(map(SHOWN.__getitem__, words))
    for at in range(0, len(met), WORDS_PER_ROW):
        if at:
            out.append(b"T*")
        shown, steps = zip(*met[at : at + WORDS_PER_ROW], strict=True)
        out += shown
        out.append(b"%g 0 Td" % -sum(steps))
    out.append(b"ET")
    return b"\n".join(out)


def tagged_content(sections: list[tuple[str, str]]) -> bytes:
    """(tag, text) sections, each on a baseline of its own and with its place as content id; Artifact has none."""
    out = [b"BT /F1 %g Tf %g 800 Td" % (SIZE, MARGIN)]
    for i, (tag, value) in enumerate(sections):
        props = b"BMC" if tag == "Artifact" else b"<< /MCID %d >> BDC" % i
        out.append(b"/%s %s 0 %g Td %s Tj EMC" % (tag.encode(), props, -LEADING, escaped(value.encode("cp1252", "replace"))))
    return b"\n".join([*out, b"ET"])


def document(pages: list, info: dict[str, str], compress: bool = True) -> bytes:
    """A document with a two-level page tree, a classic cross-reference table and an information dictionary."""
    half = (len(pages) + 1) // 2
    n = len(pages)
    first = 6  # 1 catalog, 2 root of pages, 3 and 4 its halves, 5 font
    page_no = [first + 2 * i for i in range(n)]
    info_no = first + 2 * n

    def kids(numbers: list[int]) -> bytes:
        return b"[" + b" ".join(b"%d 0 R" % k for k in numbers) + b"]"

    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R >> >> >>" % n,
        3: b"<< /Type /Pages /Parent 2 0 R /Kids %s /Count %d >>" % (kids(page_no[:half]), half),
        4: b"<< /Type /Pages /Parent 2 0 R /Kids %s /Count %d /Rotate 90 >>" % (kids(page_no[half:]), n - half),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        info_no: b"<< " + b" ".join(b"/%s %s" % (k.encode(), escaped(v.encode("cp1252", "replace"))) for k, v in info.items()) + b" >>",
    }
    out, offsets = bytearray(b"%PDF-1.7\n"), []

    def add(number: int, body: bytes) -> None:
        offsets.append(len(out))
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    for k in range(1, first):
        add(k, bodies[k])
    for i, words in enumerate(pages):
        data, name = words if isinstance(words, bytes) else page_content(words), b""
        if compress:
            data, name = zlib.compress(data, 1), b" /Filter /FlateDecode"
        add(first + 2 * i, b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (3 if i < half else 4, first + 2 * i + 1))
        add(first + 2 * i + 1, b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), name, data))
    add(info_no, bodies[info_no])
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (info_no + 1)
    out += b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (info_no + 1, info_no, start)
    return bytes(out)


def corpus_of(docs: DataFrame) -> DataFrame:
    """doc_id and content: each text as a document with one page per line of the text."""

    def of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            made = [
                document([line.split() for line in (t or "").split("\n")], {"Title": f"document {i}", "Subject": s or ""})
                for i, t, s in zip(pdf["doc_id"], pdf["text"], pdf["source"], strict=True)
            ]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": made})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    # documents are costly to make and read: the number of partitions is stated, as files and their row groups say little of it
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return rows.mapInPandas(of, "doc_id long, content binary")


def tagged_corpus_of(sections: DataFrame) -> DataFrame:
    """doc_id and content from rows (doc_id, ord, tag, text): one tagged page each."""

    def of(doc_id: int, rows: list[dict]) -> bytes:
        return document([tagged_content([(x["tag"], x["text"] or "") for x in rows])], {})

    return per_document(sections, of)


def read_files(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder as a corpus: path, content and a doc_id hashed from the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")
