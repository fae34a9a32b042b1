"""Near-duplicate detection: MinHash minima, banding, signature verification, exact links, components.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a
   128-bit fingerprint of the set and ``BANDS * ROWS`` universal-hash minima.
   Texts with equal sets are one class, represented by its smallest doc_id, so
   thousands of copies cost one representative.
2. Representatives meet in band buckets. In each bucket signatures (one bit of
   each minimum) are compared; those that may reach the threshold are linked to
   the smallest member they hang together with, one row per member. A bucket
   of over ``TILE`` members is split into tiles that meet pairwise.
3. Components of these candidate links are found by large-star/small-star. Every
   true link lies inside one such cluster, up to the chance that a pair at the
   threshold shares no bucket, (1 - 0.8**ROWS)**BANDS = 1.2e-7, or fails the
   signature test (6 standard deviations).
4. In each cluster full sets are intersected exactly, first with the set of the
   cluster's smallest member; only members that do not reach it meet all others,
   in tiles of bounded bytes. Links with ``100 * intersection >= percent * union``
   remain, at least one for each member that has any inside its tile, and their
   components are the result.

Defined results: null or word-less text has an empty set and links with
nothing; a row whose doc_id is null links with nothing and has no component;
repeated rows are copies of each other, and a doc_id that carries several texts
links all documents that any of them reaches (its rows without words stand
alone); ties go to the smaller doc_id; texts of any length are read whole; other
columns are never touched, whatever their names, and :func:`deduplicate` keeps
them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagequarry.llm import shingles
from pagequarry.llm.components import components
from pagequarry.llm.store import discard, written

BANDS, ROWS = 40, 5
SIGN_LONGS = 4  # 64-bit words that hold one bit of each of the BANDS * ROWS minima
#: Differing bits allowed: mean + 6 standard deviations of pairs at similarity 0.8.
MAX_DIFF = 46
TILE = 2048
#: Sets, and hashes in all of them, that one side of a tile of full sets has on average.
SET_TILE, SET_HASHES = 256, 2_000_000
#: Clusters of more members than this meet their smallest member in several tasks.
PIVOT_ROWS = 4096
#: Documents whose ids may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, fingerprint, band keys and sign bits of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_keys = shingles.keys(ROWS, 51)
        for batch in batches:
            for at, data, ends in shingles.text_chunks(batch.column("text")):
                hashes, counts = shingles.shingle_sets(data, ends, width)
                mins = shingles.minima(hashes, counts, BANDS * ROWS)
                signs = np.zeros((len(counts), SIGN_LONGS * 64), np.uint8)
                signs[:, : mins.shape[1]] = (mins >> np.uint64(17)) & np.uint64(1)
                bands = (mins.reshape(len(counts), BANDS, ROWS) * band_keys).sum(2)
                bands = shingles.mixed(bands + shingles.keys(BANDS, 77))
                fp = [shingles.per_text(shingles.mixed(hashes ^ k), counts, np.add, 0) for k in shingles.keys(2, 5)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(counts)),
                        pa.array(counts),
                        *[pa.array(x.view(np.int64)) for x in fp],
                        _lists(bands.view(np.int64)),
                        _lists(np.packbits(signs, axis=1).view(np.int64)),
                    ],
                    names=["doc_id", "n", "f1", "f2", "bands", "signs"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        of, "doc_id long, n long, f1 long, f2 long, bands array<long>, signs array<long>"
    )


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(flat))


def few_or_joined(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows, to be broadcast if they are few; else the join shuffles."""
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def bucket_rows(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of buckets in tiles, to be compared with each other: key, i, j, rep, signs; links of large buckets or None).

    Members of a bucket of over ``TILE`` rows meet its smallest member first; only those whose signatures are far from
    it go on, to be compared with all: a bucket of copies costs as many rows as it has, not their square.
    """
    keyed = reps.select("rep", "f1", F.explode("bands").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    signs = reps.select("rep", "f1", "signs")
    zero = F.lit(0)
    small = keyed.join(sizes.where(F.col("size") <= TILE).select("key"), "key").join(signs, ["rep", "f1"])
    rows = small.select("key", zero.alias("i"), zero.alias("j"), "rep", "signs")
    large = sizes.where(F.col("size") > TILE)
    n_large = large.count()
    if not n_large:
        return rows, None
    held = written(keyed.join(few_or_joined(large, n_large), "key").join(signs, ["rep", "f1"]), "near-large")
    firsts = held.groupBy("key").agg(F.min(F.struct("rep", "f1", "signs")).alias("first"))
    pivots = firsts.select("key", F.col("first.rep").alias("pivot"), F.col("first.signs").alias("pivot_signs"))
    differing = sum((F.bit_count(F.col("signs")[k].bitwiseXOR(F.col("pivot_signs")[k])) for k in range(SIGN_LONGS)), zero)
    met = held.join(few_or_joined(pivots, n_large), "key").withColumn("near", differing <= MAX_DIFF)
    links = met.where("near AND rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    far = written(met.where(~F.col("near")).select("key", "size", "rep", "f1", "signs"), "near-far")
    tiles = far.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("of_far"), F.ceil(F.first("size") / TILE).cast("int").alias("of_all"))
    tiles = few_or_joined(tiles, n_large)
    node = F.xxhash64("rep", "f1")
    every = held.join(tiles, "key").select(
        "key", F.pmod(node, F.col("of_all")).cast("int").alias("i"), F.explode(F.sequence(zero, F.col("of_far") - 1)).alias("j"), "rep", "signs"
    )
    few = far.join(tiles, "key").select(
        "key", F.explode(F.sequence(zero, F.col("of_all") - 1)).alias("i"), F.pmod(node, F.col("of_far")).cast("int").alias("j"), "rep", "signs"
    )
    return rows.unionByName(every).unionByName(few), links


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_links(reps: np.ndarray, signs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, which begin at ``starts``; rows of a bucket are in order of their id."""
    sizes = np.diff(np.append(starts, len(reps)))
    a_parts, b_parts = [], []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(signs[a] ^ signs[b]).sum(1) <= MAX_DIFF
        a_parts.append(a[near])
        b_parts.append(b[near])

    for size in np.unique(sizes[(sizes > 1) & (sizes <= 48)]):
        at = starts[sizes == size]
        x, y = np.triu_indices(size, 1)
        step = max(1, 500_000 // len(x))
        for k in range(0, len(at), step):
            compare((at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel())
    for at, size in zip(starts[sizes > 48], sizes[sizes > 48], strict=True):
        step = max(1, 500_000 // size)
        for k in range(0, size, step):
            x, y = np.meshgrid(np.arange(k, min(k + step, size)), np.arange(size), indexing="ij")
            later = y > x
            compare(at + x[later], at + y[later])
    if not a_parts:
        return reps[:0], reps[:0]
    label = labels(len(reps), np.concatenate(a_parts), np.concatenate(b_parts))
    moved = label != np.arange(len(reps))
    return reps[moved], reps[label[moved]]


def candidate_links(reps: DataFrame) -> DataFrame:
    """u, v: members of a bucket whose signatures hang together with a smaller member's."""
    members, links = bucket_rows(reps)
    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            rep = table.column("rep").to_numpy()
            signs = table.column("signs").combine_chunks().flatten().to_numpy().reshape(-1, SIGN_LONGS).view(np.uint64)
            new = np.ones(len(rep), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            u, v = _bucket_links(rep, signs, np.flatnonzero(new))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.all([batch.column(c).to_numpy() == x for c, x in zip(("key", "i", "j"), last, strict=True)], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and [held[-1].column(c)[-1].as_py() for c in ("key", "i", "j")] != last:
                yield flush(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    found = dealt.select("key", "i", "j", "rep", "signs").mapInArrow(link, "u long, v long")
    return (found if links is None else found.unionByName(links)).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep and its sorted shingle hashes, for the representatives in ``wanted`` (rep, f1, f2)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ends in shingles.text_chunks(batch.column("text")):
                hashes, counts = shingles.shingle_sets(data, ends, width)
                fp = [shingles.per_text(shingles.mixed(hashes ^ k), counts, np.add, 0) for k in shingles.keys(2, 5)]
                cuts = np.concatenate(([0], np.cumsum(counts)))
                sets = [hashes[p:q].tobytes() for p, q in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(at, len(counts)), *[pa.array(x.view(np.int64)) for x in fp], pa.array(sets, pa.binary())],
                    names=["rep", "g1", "g2", "hashes"],
                )

    ids = wanted.select("rep").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi")
    found = texts.mapInArrow(of, "rep long, g1 long, g2 long, hashes binary")
    # a repeated doc_id may carry other texts: only the classes that it represents count, each once
    own = found.join(wanted, "rep").where("g1 = f1 AND g2 = f2")
    return own.dropDuplicates(["rep", "f1", "f2"]).select("rep", "f1", "f2", "cluster", "hashes")


@F.pandas_udf(LongType())
def common_hashes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of packed hash sets."""
    sets = zip(a, b, strict=True)
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in sets], dtype="int64")


def pivot_links(sets: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """rep, f1, f2, cluster and whether the set reaches that of the cluster's smallest member.

    Of ``n`` sets at most ``n / bound`` clusters have more than ``bound``; their
    sizes are broadcast, and their smallest member goes to several tasks.
    """
    bound = max(PIVOT_ROWS, n // BROADCAST_IDS)
    parts = sizes.where(F.col("size") > bound).select("cluster", F.ceil(F.col("size") / bound).cast("int").alias("parts"))
    held = sets.join(F.broadcast(parts), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pivots = held.where("rep = cluster").dropDuplicates(["cluster"])
    spread = pivots.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias("pivot"))
    members = held.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = members.join(spread, ["cluster", "part"])
    size = (F.length("hashes") + F.length("pivot")) / 8
    return met.withColumn("common", common_hashes("hashes", "pivot")).select(
        "rep", "f1", "f2", "cluster", (100 * F.col("common") >= percent * (size - F.col("common"))).alias("linked")
    )


def exact_links(sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links by full sets that connect all members of a cluster that any link connects."""
    sizes = written(
        sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("hashes") / 8).alias("hashed")), "near-sizes"
    )
    met = written(pivot_links(sets, sizes, sets.count(), percent), "near-pivots")
    links = met.where("linked AND rep <> cluster").select(F.col("rep").alias("u"), F.col("cluster").alias("v"))
    rest = met.where(~F.col("linked")).select("rep", "f1", "f2", "cluster")
    return links.union(tile_links(sets, rest, sizes, percent))


def with_tiles(sets: DataFrame, tiles: DataFrame) -> DataFrame:
    """``sets`` of the clusters in ``tiles``, with their numbers of tiles; a large cluster's sets stay where they are.

    Few clusters are broadcast. Of many, those of over ``PIVOT_ROWS`` members
    (at most one in ``PIVOT_ROWS`` sets) still are if they fit, and the others meet by cluster.
    """
    if tiles.count() <= BROADCAST_IDS:
        return sets.join(F.broadcast(tiles), "cluster")
    bound = max(PIVOT_ROWS, sets.count() // BROADCAST_IDS)
    large = tiles.where(F.col("size") > bound)
    hot = sets.join(F.broadcast(large), "cluster")
    cold = sets.join(F.broadcast(large.select("cluster")), "cluster", "left_anti").join(tiles.where(F.col("size") <= bound), "cluster")
    return hot.unionByName(cold)


def tile_links(sets: DataFrame, rest: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """u, v: links of the sets in ``rest`` with any set of their cluster, rest tiles against tiles of all."""
    left = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("left"))
    tiles = left.join(sizes, "cluster").select(
        "cluster",
        "size",
        F.ceil(F.greatest(F.col("size") / SET_TILE, F.col("hashed") / SET_HASHES)).cast("int").alias("of_all"),
        F.ceil(F.greatest(F.col("left") / SET_TILE, F.col("left") / F.col("size") * F.col("hashed") / SET_HASHES)).cast("int").alias("of_rest"),
    )
    in_play = with_tiles(sets, written(tiles, "near-tiles"))
    if rest.count() <= BROADCAST_IDS:
        rest = F.broadcast(rest)
    node = F.xxhash64("rep", "f1")
    every = in_play.select(
        "cluster", "rep", "hashes", F.lit(False).alias("open"),
        F.pmod(node, F.col("of_all")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_rest") - 1)).alias("j"),
    )
    few = in_play.join(rest, ["cluster", "rep", "f1", "f2"], "left_semi").select(
        "cluster", "rep", "hashes", F.lit(True).alias("open"),
        F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("i"), F.pmod(node, F.col("of_rest")).cast("int").alias("j"),
    )

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "open"], kind="stable")
        reps, opened = pdf["rep"].to_numpy(), np.flatnonzero(pdf["open"])
        arrays = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        n = np.array([len(x) for x in arrays])
        owner = np.repeat(np.arange(len(arrays)), n)
        values, column = np.unique(np.concatenate(arrays), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(opened), len(arrays)), np.float64)
        for at in range(0, len(values), 4096):
            p, q = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(arrays), 4096), np.float32)
            part[owner[p:q], column[p:q] - at] = 1
            common += part[opened] @ part.T
        union = n[opened, None] + n[None, :] - common
        a, b = np.nonzero(100 * common >= percent * union)
        label = labels(len(reps), opened[a], b)
        moved = reps != reps[label]
        return pd.DataFrame({"u": reps[moved], "v": reps[label[moved]]})

    return every.union(few).groupBy("cluster", "i", "j").applyInPandas(verify, "u long, v long")


def shared_ids(found: DataFrame, reps: DataFrame) -> DataFrame:
    """u, v: links of a doc_id that carries several texts with the smallest doc_id of each of them."""
    some = found.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "f1", "f2", "n")
    marks = [F.min("f1").alias("a"), F.max("f1").alias("b"), F.min("f2").alias("c"), F.max("f2").alias("d")]
    several = written(some.groupBy("doc_id").agg(*marks).where("a <> b OR c <> d").select("doc_id"), "near-shared")
    if not several.limit(1).count():
        return reps.limit(0).select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    return some.join(several, "doc_id").join(reps.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    found = written(features(docs, width), "near-features")
    classes = (
        found.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("doc_id", "bands", "signs")).alias("first"))
        .select("f1", "f2", "n", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands"), F.col("first.signs").alias("signs"))
    )
    reps = written(classes, "near-classes")
    clusters = components(candidate_links(reps))
    both = clusters.select(F.col("u").alias("rep"), F.col("component").alias("cluster")).union(
        clusters.select("component", "component").distinct()
    )
    wanted = written(both.join(reps.select("rep", "f1", "f2"), "rep"), "near-wanted")
    sets = written(full_sets(docs, wanted, width), "near-sets")
    linked = components(exact_links(sets, percent).union(shared_ids(found, reps)))
    for used in (sets, wanted):
        discard(used)
    of_class = reps.join(linked.withColumnRenamed("u", "rep"), "rep", "left").select(
        "f1", "f2", "n", F.coalesce("component", "rep").alias("component")
    )
    own = F.col("doc_id")
    return (
        found.select("doc_id", "n", "f1", "f2")
        .join(of_class, ["f1", "f2", "n"], "left")
        .select(
            own,
            F.col("n").alias("n_shingles"),
            F.when(own.isNotNull(), F.coalesce("component", own)).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True)))
    )


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the rows whose doc_id is their component's smallest, with all columns.

    Rows that repeat a kept doc_id are the same document and stay.
    """
    verdict = near_duplicates(docs, width, percent)
    gone = written(verdict.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    if gone.count() <= BROADCAST_IDS:  # else the documents are shuffled by doc_id
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti")
