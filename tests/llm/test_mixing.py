import math

from pagequarry.llm import mixing
from tests.llm import texts


def brute_count(doc_id, rate, seed="mix"):
    import hashlib

    u = int(hashlib.md5(f"{seed}:{doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    cdf = p
    while u >= cdf:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_counts_match_inversion_and_columns_stay(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a" if i % 3 else None, 5) for i in range(300)], "doc_id long, text string, source string, copy int")
    targets = spark.createDataFrame([("a", 1.0), (None, 3.0), ("unused", 5.0)], "source string, weight double")
    out = mixing.mix(df, targets, size_factor=1.5)
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_", "shuffle_key"]
    got = {}
    for r in out.collect():
        assert r.copy == 5 and r.copy_ >= 1
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    rates = {"a": 1.5 * 300 * 0.25 / 200, None: 1.5 * 300 * 0.75 / 100}
    assert got == {i: k for i in range(300) if (k := brute_count(i, rates["a" if i % 3 else None]))}


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    df = texts.frame(spark)
    targets = df.select("source").distinct().selectExpr("source", "1.0 AS weight")
    a = sorted(r.shuffle_key for r in mixing.mix(df, targets).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(r.shuffle_key for r in mixing.mix(df, targets).collect()) == a


def test_mean_rate_and_high_rates(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    targets = spark.createDataFrame([("s", 2.0)], "source string, weight double")
    for factor in (0.5, 2.0, 40.0):
        n = mixing.mix(df, targets, size_factor=factor).count()
        assert abs(n - 2000 * factor) < 6 * math.sqrt(2000 * factor)


def test_missing_targets_and_empty_tables(spark):
    df = texts.frame(spark)
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix(df, none).count() == 0
    assert mixing.mix(df.limit(0), none).count() == 0


def test_order_is_global_and_reproducible(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    targets = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    a, b = ([(r.shuffle_key, r.doc_id) for r in mixing.mix(x, targets, 2.0).collect()] for x in (df, df.repartition(7)))
    assert sorted(a) == sorted(b) and a != sorted(a, key=lambda x: x[1])
