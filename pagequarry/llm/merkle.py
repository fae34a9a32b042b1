"""Merkle manifest of a dataset: a tree of digests whose parents keep copied hash states.

H is the lowercase hex SHA-256 of its inputs, one after the other; digests enter as
hex text. A row is a leaf. Within a partition value (``by``) leaves ascend by id;
while several nodes remain, every ``ARITY`` consecutive ones (the last run may be
shorter) become their H. What remains of each value is its subroot; subroots,
ordered by value (null first, bytewise), give the root likewise.

A parent hashes its children once and keeps a copy of the hash state *before each
child slot* (the midstate). To fold a replaced child it resumes that copy and feeds
the replacement and the right siblings only; left siblings are not read again.

Spark deals the work by chunks of ``SPAN`` consecutive nodes, three levels of one
value: chunk roots are made round by round until one node a value is left, then the
paths of chunks (the siblings above them) come down the same rounds, and each leaf
is folded in its chunk, along states kept for the chunk and for its path. Nodes are
numbered by dealing them by ranges and adding offsets, so a value that holds most
rows meets in no task.

Defined results: a null column enters as ``-``; equal ids ascend by leaf; null ids
come first and are never tampered with; a value with one leaf has it as subroot; a
proof without siblings is the digest of nothing; repeated rows are leaves of their
own; long texts are hashed whole; columns that are not named are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.store import written

ARITY = 8
LEVELS = 3  # of a chunk
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Siblings above a node: at each level those to the left and those to the right, as hex text.
PATH = "array<struct<left:binary,right:binary>>"


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 length, a colon and its value."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]).cast("binary"), 256)


def tampered_text() -> Column:
    """``text`` with A-Z in lower case where 3 divides the unsigned CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (with ``key``) with ``pos`` from 0 in the key's order and ``n``, the nodes of the key."""
    ranged = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-nodes")
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_at", 33))
    counts = ranged.groupBy("_range", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("key")
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", "key", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n"))
    return ranged.join(offsets, ["_range", "key"]).select(*nodes.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")


class Tree:
    """Up to ``LEVELS`` levels over the digests of one chunk, with the hash state before every slot."""

    def __init__(self, digests: list[bytes], whole: bool) -> None:
        """``whole``: the chunk holds all nodes of its key, so levels end where one node is left."""
        self.levels, self.states = [digests], []
        while len(self.states) < LEVELS and not (whole and len(self.levels[-1]) == 1):
            below, states, above = self.levels[-1], [], []
            for p in range(0, len(below), ARITY):
                state = hashlib.sha256()
                for child in below[p : p + ARITY]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append(above)
            self.states.append(states)
        self.root = self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Left and right siblings of node ``i`` and its ancestors below the chunk's root."""
        found = []
        for level in self.levels[: len(self.states)]:
            p = i - i % ARITY
            found.append((b"".join(level[p:i]), b"".join(level[i + 1 : p + ARITY])))
            i //= ARITY
        return found

    def fold(self, i: int, digest: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
        """The chunk's root with ``digest`` in place of node ``i``."""
        for states, (_, right) in zip(self.states, siblings, strict=True):
            state = states[i].copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
            i //= ARITY
        return digest


def _roots(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    n = nodes.column("n")[0].as_py()
    root = Tree([d.encode() for d in nodes.column("digest").to_pylist()], n <= SPAN).root.decode()
    return pa.table({"key": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // SPAN)], pa.int64()), "digest": [root]})


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes, chunk roots, roots of their chunks, ... until each key has one node; the logarithm of the table's size."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        chunks = found[-1].select("key", F.floor(F.col("pos") / SPAN).alias("chunk"), "pos", "n", "digest").groupBy("key", "chunk")
        found.append(written(chunks.applyInArrow(_roots, "key string, pos long, n long, digest string"), "merkle-round"))
    return found


def _paths(key: tuple[pa.Scalar, ...], nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    tree = Tree([d.encode() for d in nodes.column("digest").to_pylist()], nodes.column("n")[0].as_py() <= SPAN)
    upper = above.column("path")[0].as_py()
    paths = [[{"left": a, "right": b} for a, b in tree.siblings(i)] + upper for i in range(len(nodes))]
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    return pa.table({"key": nodes.column("key"), "pos": nodes.column("pos"), "path": pa.array(paths, kind)})


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """key, pos and path of the nodes of ``levels[0]``; ``tops`` has the path of each key's last node."""
    paths = tops.select("key", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(levels[:-1]):
        own = nodes.select("key", F.floor(F.col("pos") / SPAN).alias("chunk"), "pos", "n", "digest").groupBy("key", "chunk")
        above = paths.select("key", F.col("pos").alias("chunk"), "path").groupBy("key", "chunk")
        paths = own.cogroup(above).applyInArrow(_paths, f"key string, pos long, path {PATH}")
    return paths


_ROW = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(with_siblings: bool):
    def of(key: tuple[pa.Scalar, ...], rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves = [d.encode() for d in rows.column("digest").to_pylist()]
        tree = Tree(leaves, rows.column("n")[0].as_py() <= SPAN)
        upper = [(x["left"], x["right"]) for x in above.column("path")[0].as_py()]
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        states = []
        for left, _ in upper:  # once a chunk: the states before the slots of its ancestors
            states.append(hashlib.sha256(left))
        tail = b"".join(a + b for a, b in upper)
        proofs, folded, lists = [], [], []
        for i, (own, new) in enumerate(zip(leaves, rows.column("new").to_pylist(), strict=True)):
            siblings = tree.siblings(i)
            told = b"".join([x for pair in siblings for x in pair]) + tail
            proofs.append(hashlib.sha256(told).hexdigest())
            digest = tree.fold(i, new.encode() if new is not None else own, siblings)
            for before, (_, right) in zip(states, upper, strict=True):
                state = before.copy()
                state.update(digest)
                state.update(right)
                digest = state.hexdigest().encode()
            folded.append(digest.decode())
            if with_siblings:
                lists.append([told[p : p + 64].decode() for p in range(0, len(told), 64)])
        n = len(rows)
        out = {
            "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        }
        if with_siblings:
            out["siblings"] = pa.array(lists, pa.list_(pa.string()))
        return pa.table(out)

    return of


def manifest(docs: DataFrame, by: str = "lang", fields: Sequence[str] = FIELDS, text: Column | None = None, siblings: bool = False) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``text`` stands in for the text of the row that is folded back (by default the
    row's own, so that every row verifies). With ``siblings`` the proof itself follows:
    the digests of the run's other nodes, level by level up to the root.
    """
    own = leaf(fields)
    new = leaf(fields, text=text) if text is not None else own
    key = F.when(F.col(f"`{by}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{by}`").cast("string")))
    leaves = docs.select("doc_id", key.alias("key"), own.alias("digest"), new.alias("new"))
    leaves = leaves.withColumn("new", F.when(F.col("new") != F.col("digest"), F.col("new")))
    rows = placed(leaves, ["doc_id", "digest"])
    low = rounds(rows.select("key", "pos", "n", "digest"))
    subroots = written(low[-1].select("key", F.col("digest").alias("subroot")), "merkle-subroots")
    values = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("value"), F.col("subroot").alias("digest")), ["value"])
    high = rounds(values.select("key", "pos", "n", "digest"))
    root = high[-1].select("key", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = descend(high, root).join(values.select("key", "pos", "value", F.col("digest").alias("subroot")), ["key", "pos"]).join(root.select("key", "root"), "key")
    tops = written(above.select(F.col("value").alias("key"), "path", "subroot", "root"), "merkle-tops")  # one row a value
    if len(low) > 1:
        paths = descend(low[1:], tops)
    else:
        paths = tops.select("key", F.lit(0).cast("long").alias("pos"), "path")
    heads = paths.join(tops.select("key", "subroot", "root"), "key").select("key", F.col("pos").alias("chunk"), "path", "subroot", "root")
    grouped = rows.withColumn("chunk", F.floor(F.col("pos") / SPAN)).groupBy("key", "chunk")
    schema = _ROW.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", siblings array<string>" if siblings else "")
    return grouped.cogroup(heads.groupBy("key", "chunk")).applyInArrow(_folded(siblings), schema)


def fold(digest: bytes, siblings: Sequence[tuple[Sequence[str], Sequence[str]]]) -> str:
    """The root that a leaf and its (left, right) siblings of every level give, in plain Python."""
    for left, right in siblings:
        digest = hashlib.sha256(b"".join([*(x.encode() for x in left), digest, *(x.encode() for x in right)])).hexdigest().encode()
    return digest.decode()


def report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with every third document (by hash) tampered with before it is folded back."""
    return manifest(docs, text=tampered_text())
