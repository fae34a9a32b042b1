"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers ``floor(64 * x)``, packed into blocks of ``BLOCK`` rows.
Every block of queries meets every block of candidates (a stated query set
against all rows, in blocks). While the packed queries are at most
``BROADCAST_BYTES`` they are broadcast and no candidate moves; beyond that,
query blocks and candidate blocks meet by (query block, slice of the candidates).
Each round scores everything and adds up one histogram per query, first inside
the task; the bin with the k-th highest score becomes the next round's range,
until a bin is a single score. A last round keeps scores above the k-th value
and, of those equal to it, only as many of the smallest ids of each block as are
still needed, so ties cannot flood the result; ranks are then exact.

Scores are exact: by float products below 2**53, by 64-bit ones below 2**62, and
by Python integers for the rows of a block that exceed that.

Defined results: vectors that are null or hold null or non-finite components
take no part; components beyond the double range after scaling count as the
largest double; scores beyond +-(2**62 - 1) count and are reported as that, ties
among them by vec_id like all others; of vectors of unequal length the shorter
counts as padded with zeros; repeated vectors are distinct rows with their own
ids, repeated rows of one id are candidates each (as a query the smallest of
them counts); empty tables give empty results; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.store import discard, written

SCALE = 64
BLOCK = 1024
QUERY_BLOCK = 2048
BINS = 256
#: Packed queries that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Candidate blocks that one slice has where the queries are not broadcast.
SLICE_BLOCKS = 64
#: Query blocks whose histograms a task holds at a time (4 MB each).
HELD = 16
FLOAT_EXACT, LONG_EXACT = 2.0**53, 2.0**62
MOST = 2**62 - 1
LARGEST = float(np.finfo(np.float64).max)


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and integer components (as doubles, which hold them exactly) of the rows that take part."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))
    )

    def whole(v):
        scaled = F.least(F.greatest(v.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
        # floor() gives a long; beyond 2**53 every double is an integer already
        return F.when(F.abs(scaled) < FLOAT_EXACT, F.floor(F.when(F.abs(scaled) < FLOAT_EXACT, scaled)).cast("double")).otherwise(scaled)

    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q"))


def _pack(pdf: pd.DataFrame) -> dict:
    """Rows as one (ids, width, values) block; short vectors are padded with zeros."""
    width = max((len(v) for v in pdf["q"]), default=0)
    m = np.zeros((len(pdf), width), np.float64)
    for i, v in enumerate(pdf["q"]):
        m[i, : len(v)] = v
    return {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "width": width, "values": m.tobytes()}


def candidate_blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` rows, packed where the rows lie."""

    def pack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), size):
                yield pd.DataFrame([_pack(pdf.iloc[at : at + size])])

    return vectors.mapInPandas(pack, "ids binary, width int, values binary")


def query_blocks(queries: DataFrame, groups: int) -> DataFrame:
    """The queries dealt by hash over ``groups`` blocks of about ``QUERY_BLOCK`` rows."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = _pack(pdf.sort_values("vec_id", kind="stable"))
        return pd.DataFrame([{"g": key[0], **{f"q_{k}": v for k, v in block.items()}}])

    dealt = queries.withColumn("g", _group(F.col("vec_id"), groups))
    return dealt.groupBy("g").applyInPandas(pack, "g int, q_ids binary, q_width int, q_values binary")


def _group(vec_id, groups: int):
    return F.pmod(F.xxhash64(vec_id), F.lit(groups)).cast("int")


def _unpacked(ids: bytes, width: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(values, np.float64).reshape(len(i), width)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact or at +-MOST where they lie beyond it."""
    with np.errstate(over="ignore", invalid="ignore"):
        qn, cn = (np.sqrt((m**2).sum(1)) * (1 + 1e-9) for m in (q, c))  # no sum of products exceeds qn * cn
        q_most, c_most = qn.max(initial=0.0), cn.max(initial=0.0)
        if not q_most * c_most >= FLOAT_EXACT:
            return (q @ c.T).astype(np.int64)
        if q_most * c_most < LONG_EXACT:
            return q.astype(np.int64) @ c.astype(np.int64).T
        wide_q, wide_c = ~(qn * c_most < LONG_EXACT), ~(cn * q_most < LONG_EXACT)
    out = np.zeros((len(q), len(c)), np.int64)
    for q_rows, q_wide in ((np.flatnonzero(~wide_q), False), (np.flatnonzero(wide_q), True)):
        for c_rows, c_wide in ((np.flatnonzero(~wide_c), False), (np.flatnonzero(wide_c), True)):
            if len(q_rows) and len(c_rows):
                part = _by_integers if q_wide or c_wide else products
                out[np.ix_(q_rows, c_rows)] = part(q[q_rows], c[c_rows])
    return out


def _by_integers(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    return np.clip(a @ b.T, -MOST, MOST).astype(np.int64)


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, integer scores and which pairs count (a query never meets its own id)."""
    qi, q = _unpacked(row.q_ids, row.q_width, row.q_values)
    ci, c = _unpacked(row.ids, row.width, row.values)
    w = min(q.shape[1], c.shape[1])
    return qi, ci, products(q[:, :w], c[:, :w]), ci[None, :] != qi[:, None]


def _histograms(pairs: DataFrame, span: int) -> DataFrame:
    """Counts by query and bin of each query's present range of ``span`` scores."""

    def rows(held: dict) -> pd.DataFrame:
        parts = [(qi, *np.nonzero(counts), counts) for qi, counts in held.values()]
        held.clear()
        return pd.DataFrame(
            {
                "query_id": np.concatenate([qi[at] for qi, at, _, _ in parts]),
                "bin": np.concatenate([b for _, _, b, _ in parts]).astype(np.int32),
                "n": np.concatenate([counts[at, b] for _, at, b, counts in parts]),
            }
        )

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in pdfs:
            for row in pdf.itertuples():
                qi, _, s, other = _scores(row)
                low, width = (np.asarray(x, np.int64)[:, None] for x in (row.low, row.step))
                above = s - low  # within 64 bits, since both lie within +-MOST - 1
                b = np.floor_divide(above, width)
                inside = other & (b >= 0) & (b < BINS) & (above < span)
                flat = (np.arange(len(qi))[:, None] * BINS + b)[inside]
                counts = np.bincount(flat, minlength=len(qi) * BINS).reshape(len(qi), BINS)
                if row.g in held:
                    np.add(held[row.g][1], counts, out=held[row.g][1])
                else:
                    held[row.g] = qi, counts
                if len(held) > HELD:
                    yield rows(held)
        if held:
            yield rows(held)

    return pairs.mapInPandas(count, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _selected(pairs: DataFrame) -> DataFrame:
    """Scores above each query's k-th value, and the smallest ids of a block among those equal to it."""

    def select(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                qi, ci, s, other = _scores(row)
                kth, needed = (np.asarray(x, np.int64)[:, None] for x in (row.low, row.needed))
                order = np.argsort(ci, kind="stable")
                tied = (other & (s == kth))[:, order]
                keep = other & (s > kth)
                keep[:, order] |= tied & (np.cumsum(tied, axis=1) <= needed)
                at, c = np.nonzero(keep)
                yield pd.DataFrame({"query_id": qi[at], "vec_id": ci[c], "score": s[at, c]})

    return pairs.mapInPandas(select, "query_id long, vec_id long, score long")


def _pairs(candidates: DataFrame, queries: DataFrame, state: DataFrame, groups: int, slices: int) -> DataFrame:
    """Every block of candidates with every block of queries and its queries' ranges; no slices: the queries are broadcast."""
    by_block = state.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "step", "needed"))).alias("r"))
    ranged = queries.join(by_block, "g").select(
        "g", "q_ids", "q_width", "q_values", *[F.col(f"r.{c}").alias(c) for c in ("low", "step", "needed")]
    )
    every = candidates.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if not slices:
        return every.join(F.broadcast(ranged), "g")
    mine = every.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    return mine.join(ranged.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["g", "slice"])


def exact_topk(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row that ``is_query`` selects."""
    valid = quantized(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding"))
    queries = valid.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    norm2 = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    n, width, total, most, q_most = valid.agg(
        F.sum(F.when(is_query, 1).otherwise(0)), F.max(F.size("q")), F.count(F.lit(1)), F.max(norm2), F.max(F.when(is_query, norm2))
    ).first()
    groups = max(1, -(-(n or 0) // QUERY_BLOCK))
    bound = min(math.sqrt(most or 0.0) * math.sqrt(q_most or 0.0) * (1 + 1e-9) + 1, float(MOST))
    bound = min(int(bound), MOST)
    slices = 0 if (n or 0) * (8 * (width or 0) + 40) <= BROADCAST_BYTES else -(-total // (BLOCK * SLICE_BLOCKS))
    candidates = written(candidate_blocks(valid), "topk-candidates")
    packed = written(query_blocks(queries, groups), "topk-queries")
    span = 2 * bound + 1
    step = -(-span // BINS)
    state = queries.select(
        F.col("vec_id").alias("query_id"),
        _group(F.col("vec_id"), groups).alias("g"),
        F.lit(-bound).cast("long").alias("low"),
        F.lit(step).cast("long").alias("step"),
        F.lit(k).cast("long").alias("needed"),
    )
    downward, before = Window.partitionBy("query_id").orderBy(F.desc("bin")), None
    while True:
        counts = _histograms(_pairs(candidates, packed, state, groups, slices), span).withColumn("cum", F.sum("n").over(downward))
        located = counts.join(state.select("query_id", "needed"), "query_id").where(
            (F.col("cum") >= F.col("needed")) & (F.col("cum") - F.col("n") < F.col("needed"))
        )
        finer = -(-step // BINS)
        # a query with fewer than k candidates keeps them all: its k-th value lies below every score
        state = written(
            state.join(located.select("query_id", "bin", (F.col("cum") - F.col("n")).alias("above")), "query_id", "left").select(
                "query_id",
                "g",
                F.coalesce(F.col("low") + F.col("bin") * F.lit(step).cast("long"), F.lit(-bound - 1).cast("long")).alias("low"),
                F.lit(finer).cast("long").alias("step"),
                F.coalesce(F.col("needed") - F.col("above"), F.col("needed")).cast("long").alias("needed"),
            ),
            "topk-state",
        )
        if before is not None:
            discard(before)
        before = state
        if step == 1:
            break
        span, step = step, finer
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        _selected(_pairs(candidates, packed, state, groups, slices))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
