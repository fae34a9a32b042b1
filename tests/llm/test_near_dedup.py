import random
import re

from pyspark.sql import functions as F

from pagequarry.llm import components, near_dedup
from tests.llm import texts
from tests.llm.brute import W


def brute(rows, width, percent):
    """{doc_id: (set size, component)}; rows of a repeated doc_id hang together unless they have no words."""

    def shingles(text):
        words = re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < width:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(x), find(i)) for i, x in sets}


def family(seed, n):
    rng = random.Random(seed)
    base = texts.prose(rng, "en", 120).split()
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = texts.prose(rng, "en", 1)
        out.append((1000 + i, " ".join(words)))
    return out


def check(spark, rows, width):
    want = brute(rows, width, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in near_dedup.near_duplicates(df, width).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.component_id == r.doc_id)


def test_components_match_brute_force(spark):
    rows = list({r[0]: (r[0], r[1]) for r in texts.rows()}.values())
    check(spark, rows + family(5, 80), 4)
    check(spark, family(6, 40), 5)


def test_tiles_do_not_lose_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "SET_TILE", 8)
    check(spark, family(7, 60), 4)


def test_a_pivot_that_few_reach_loses_no_link(spark, monkeypatch):
    """A chain of texts, each like the next one only, split over several tiles and pivot tasks."""
    monkeypatch.setattr(near_dedup, "SET_TILE", 4)
    monkeypatch.setattr(near_dedup, "PIVOT_ROWS", 3)
    rng = random.Random(12)
    words = [texts.prose(rng, "en", 1) + str(i) for i in range(400)]
    chain = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(40)]
    check(spark, [*chain, *family(8, 20)], 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 3)
    check(spark, [*chain, *family(8, 20)], 4)


def test_repeated_ids_with_other_texts(spark):
    a, b, c, d = (texts.prose(random.Random(i), "en", 40) for i in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (5, c), (6, c), (6, d), (7, d), (6, d), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 8)}
    assert {(i, c) for i, (_, c) in brute(rows, 4, 80).items()} == got


def test_long_texts_and_repeated_rows(spark):
    rng = random.Random(2)
    long = texts.prose(rng, "en", 60_000)
    check(spark, [(1, long), (2, long + " end"), (3, "x " + long), (4, "word " * 50_000), (5, "word word word word")], 4)
    df = spark.createDataFrame([(9, long)] * 3 + [(10, "a b c d e")] * 2, "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == [(9, 9)] * 3 + [(10, 10)] * 2
    assert near_dedup.deduplicate(df).count() == 5


def test_deduplicate_keeps_columns_and_one_per_group(spark):
    df = texts.frame(spark)
    out = near_dedup.deduplicate(df)
    assert sorted(out.columns) == sorted(df.columns)
    ids = [r.doc_id for r in out.collect()]
    assert 8 in ids and 60 not in ids and 61 not in ids and 63 in ids and 64 in ids and 66 in ids and 67 not in ids


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False)}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_star_rounds_on_a_path_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_EDGES", 4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.u: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_a_large_bucket_grow_linearly(spark):
    """A hundred thousand alike representatives in every band, and some that only share buckets with them."""
    n, strange = 100_000, 300
    base = F.array(*[F.lit(0).cast("long")] * near_dedup.SIGN_LONGS)
    other = F.array(*[F.lit(-1).cast("long")] * near_dedup.SIGN_LONGS)
    bands = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: k.cast("long"))
    alike = spark.range(n).select(F.col("id").alias("rep"), F.col("id").alias("f1"), bands.alias("bands"), base.alias("signs"))
    odd = spark.range(n, n + strange).select(F.col("id").alias("rep"), F.col("id").alias("f1"), bands.alias("bands"), other.alias("signs"))
    reps = alike.union(odd)
    rows, links = near_dedup.bucket_rows(reps)
    total = (n + strange) * 3
    assert rows.count() <= 2 * total and links.distinct().count() == n - 1
    own = near_dedup.candidate_links(spark.range(0, 3000).select(F.col("id").alias("rep"), F.col("id").alias("f1"), bands.alias("bands"), F.when(F.col("id") % 3 == 0, base).otherwise(other).alias("signs")))
    seen = {(r.u, r.v) for r in own.collect()}
    label = list(range(3000))
    for u, v in sorted(seen, key=lambda x: (x[1], x[0])):  # links lead to smaller members
        label[u] = label[v]
    assert label == [0 if i % 3 == 0 else 1 for i in range(3000)]
