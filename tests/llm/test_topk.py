import math
import random

from pyspark.sql import functions as F

from pagequarry.llm import topk


def brute(rows, k):
    ok = {i: [math.floor(max(-topk.LARGEST, min(topk.LARGEST, 64 * x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            scored = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(ok[q], ok[c])))), c) for c in ok if c != q)
            out[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return {q: v for q, v in out.items() if v}


def check(spark, rows, k, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, score string").repartition(3)
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute([r[:2] for r in rows], k)


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    # values of few bits, so that floats and doubles agree
    rows = [(i, [rng.randint(-40, 40) / 64 for _ in range(6)], 1, "x") for i in range(300)]
    rows += [(1000 + i, rows[20][1], 1, "x") for i in range(60)]
    rows += [(2000, None, 1, "x"), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (2040, [float("nan")] * 6, 1, "x"), (2060, [float("inf")] * 6, 1, "x")]
    check(spark, rows, 20)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(i, [i / 64, 1.0], 1, "x") for i in range(15, 25)]
    check(spark, rows, 20)
    check(spark, rows[:0], 20)
    check(spark, [(20, [1.0], 1, "x")], 3)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(4)
    rows = [(i, [rng.randint(-4, 4) / 64 for _ in range(3)], 1, "x") for i in range(400)]
    check(spark, rows, 7)


def test_slices_where_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE_BLOCKS", 4)
    monkeypatch.setattr(topk, "HELD", 2)
    rng = random.Random(5)
    check(spark, [(i, [rng.randint(-9, 9) / 64 for _ in range(4)], 1, "x") for i in range(300)], 9)


def test_large_values_are_exact_or_saturate(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)], 1, "x") for i in range(120)]
    for i, scale in ((7, 1e9), (20, 1e9), (33, 3e7), (40, 1e20), (41, 1e300), (55, 4e7), (60, 3e7)):
        rows[i] = (i, [rng.uniform(-2, 2) * scale for _ in range(4)], 1, "x")
    check(spark, rows, 20, "double")
    check(spark, [(i, [1e308, -1e308], 1, "x") for i in range(18, 24)], 3, "double")


def test_unequal_lengths_and_clashing_names(spark):
    rows = [(i, [float(i % 5)] * (1 + i % 4), 3, 4) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, g int, q int")
    want = {}
    for i, v, *_ in rows[::20]:
        scored = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), c) for c, w, *_ in rows if c != i)
        want[i] = [(r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])]
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == want
