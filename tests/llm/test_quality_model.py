import random

import numpy as np

from pagequarry.llm import quality_model
from pagequarry.llm.quality_rules import metrics, ratios
from pyspark.sql import functions as F
from tests.llm import texts


def brute_votes(row):
    out = []
    for lab in quality_model.LABELLERS:
        x = row[lab.metric]
        if lab.above:
            out.append(0 if x <= lab.bad else 1 if x >= lab.good else -1)
        else:
            out.append(0 if x >= lab.bad else 1 if x <= lab.good else -1)
    return out


def brute_posteriors(patterns, rounds=100):
    """The same estimate, document by document instead of by counted pattern."""
    p = [min(max((v.count(1) / (len(v) - v.count(-1))) if len(v) > v.count(-1) else 0.5, 0.05), 0.95) for v in patterns]
    for _ in range(rounds):
        prior = np.log((sum(p) + 1) / (sum(1 - q for q in p) + 1))
        odds = {}
        for j in range(len(quality_model.LABELLERS)):
            for v in (0, 1):
                good = sum(q for q, x in zip(p, patterns) if x[j] == v) + 1
                bad = sum(1 - q for q, x in zip(p, patterns) if x[j] == v) + 1
                good_all = sum(q for q, x in zip(p, patterns) if x[j] >= 0) + 2
                bad_all = sum(1 - q for q, x in zip(p, patterns) if x[j] >= 0) + 2
                odds[j, v] = np.log(good / good_all) - np.log(bad / bad_all)
        new = [1 / (1 + np.exp(-np.clip(prior + sum(odds.get((j, v), 0) for j, v in enumerate(x)), -30, 30))) for x in patterns]
        if max(abs(a - b) for a, b in zip(p, new)) < 1e-9:
            break
        p = new
    return p


def test_posteriors_match_brute_force(spark):
    df = texts.frame(spark)
    measured = df.select("doc_id", metrics(F.col("text")).alias("m"))
    rows = measured.select("doc_id", *[x.alias(k) for k, x in ratios(F.col("m")).items()]).collect()
    want = dict(zip([r.doc_id for r in rows], brute_posteriors([brute_votes(r.asDict()) for r in rows])))
    for r in quality_model.score(df).collect():
        assert abs(r.posterior - want[r.doc_id]) < 1e-6


def test_scores_separate_junk_and_follow_defined_results(spark):
    rng = random.Random(1)
    good = [(i, texts.prose(rng, "en", 90) + " the and of the to") for i in range(40)]
    bad = [(100 + i, " ".join(w.upper() + "$$$" for w in texts.prose(rng, "en", 40).split())) for i in range(20)]
    more = [(200, None), (201, ""), (202, "word " * 30_000), (0, good[0][1]), (None, good[1][1])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in [*good, *bad, *more]], "doc_id long, text string, pattern string, place double")
    found = quality_model.score(df).collect()
    got = {r.doc_id: r for r in found}
    assert all(got[i].good for i, _ in good) and not any(got[i].good for i, _ in bad)
    assert len(found) == 65 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found)
    twice = [r for r in found if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1] and got[None].score == got[1].score
    assert got[200].score == got[201].score
    assert quality_model.score(df.limit(0)).count() == 0


def test_sample_neither_vanishes_nor_follows_the_layout(spark, monkeypatch):
    for n in (10**3, 10**9, 10**12, 10**15):
        share = (quality_model.hash_bound(n, 4000) + 2**63 + 1) / 2**64
        assert abs(share * n - min(n, 4000)) <= 1
    assert quality_model.hash_bound(0, 4000) == 2**63 - 1
    monkeypatch.setattr(quality_model, "MAX_SAMPLE", 50)
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "0 AS pattern")
    one, two = ([r.doc_id for r in quality_model.sampled(x, 3000).collect()] for x in (df.repartition(9), df.coalesce(1)))
    assert one == two and len(one) == 50
    alike = spark.range(500).selectExpr("7L AS doc_id", "'same' AS text", "0 AS pattern")
    assert quality_model.sampled(alike, 500).count() == 50
