"""Command line: ``python -m pagequarry MODE PATH...`` prints one JSON object a line.

Modes: content-streams, outline, structure, text, text-objects, images, fonts, labels, annotations, fields, objects.
``--pages`` is a comma-separated list of zero-based pages, for the modes that have pages.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import images, navigation, structure, text
from pagequarry.plans.documents import Parsed
from pagequarry.sources import render, sinks

def logical_text(p: Parsed, space: str) -> DataFrame:
    """Text of each page; tagged pages in the order of the structure and with its ActualText."""
    elems = structure.elements(p.live, p.roots)
    content = structure.contents(p.live, elems)
    ranks, actual = structure.logical_ranks(content, elems, p.pages), structure.actual_texts(content, elems, p.pages)
    runs = p.runs(flatten=True, space=space, kinds=("text",))
    return text.extract_text(runs, p.roots.where("tagged"), "screen" if space == "screen" else "page", ranks, actual)


#: What each mode shows of a parsed corpus, and the columns that order it.
MODES: dict[str, tuple[Callable[[Parsed, str], DataFrame], tuple[str, ...]]] = {
    "content-streams": (lambda p, _: p.content.withColumn("content", F.base64("content")), ("doc_id", "page_index")),
    "outline": (lambda p, _: navigation.outline(p.live, p.roots), ("doc_id", "place")),
    "structure": (lambda p, _: structure.elements(p.live, p.roots), ("doc_id", "dfs_index")),
    "text": (lambda p, space: logical_text(p, space), ("doc_id", "page_index")),
    "text-objects": (lambda p, space: p.runs(space=space).where("kind = 'text'"), ("doc_id", "page_index", "seq")),
    "images": (lambda p, _: images.decoded_images(p.live, p.resources).withColumn("samples", F.sha2("samples", 256)), ("doc_id", "page_index", "name")),
    "fonts": (lambda p, _: images.fonts(p.live, p.resources), ("doc_id", "name")),
    "labels": (lambda p, _: navigation.page_labels(p.live, p.roots, p.pages), ("doc_id", "page_index")),
    "annotations": (lambda p, _: navigation.annotations(p.live, p.pages), ("doc_id", "page_index", "seq")),
    "fields": (lambda p, _: navigation.form_fields(p.live, p.roots), ("doc_id", "full_name")),
    "objects": (lambda p, _: p.objects.drop("stream"), ("doc_id", "seq")),
}


def shown(spark: SparkSession, mode: str, path: str, pages: list[int] | None = None, space: str = "screen") -> DataFrame:
    """Ordered rows of a mode for the documents at ``path`` (a file, folder or pattern), with each document's path."""
    files = render.read_files(spark, path)
    find, order = MODES[mode]
    rows = find(Parsed(files.select("doc_id", "content"), pages), space)
    return files.select("doc_id", "path").join(rows, "doc_id").orderBy("path", *order[1:]).drop("doc_id")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagequarry", description=__doc__)
    parser.add_argument("mode", choices=sorted(MODES))
    parser.add_argument("path", nargs="+")
    parser.add_argument("--pages", help="zero-based pages, such as 0,2,5")
    parser.add_argument("--space", choices=("screen", "page", "default"), default="screen")
    options = parser.parse_args(arguments)
    pages = [int(p) for p in options.pages.split(",")] if options.pages else None
    spark = SparkSession.builder.appName("pagequarry").getOrCreate()
    for path in options.path:
        for row in sinks.json_lines(shown(spark, options.mode, path, pages, options.space)).toLocalIterator():
            print(row["value"])


if __name__ == "__main__":
    main()
