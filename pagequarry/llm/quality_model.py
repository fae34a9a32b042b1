"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text (native
expressions over its metrics). Expectation-maximisation on the counts of vote
patterns (at most 3 ** labellers, of *all* documents) estimates each labeller's
accuracy on either class, which turns votes into a posterior. A hashed linear
scorer is then fitted to the posteriors of a bounded sample (``MAX_SAMPLE``
documents, those with the smallest hashes of doc_id and text) and scores every
whole text.

The metrics are worked out once: doc_id, text and the vote pattern (one small
integer) go to the shared folder, and counts, sample and scores read that table.

Defined results: null and empty text has metrics of zero and no n-grams, and
is scored by the bias; a table where no labeller votes gets posterior 0.5;
repeated rows and ties in the hash are scored alike; texts of any length are
read whole; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import ngrams
from pagequarry.llm.exprs import let
from pagequarry.llm.quality_rules import metrics, ratios
from pagequarry.llm.store import written

MAX_SAMPLE = 2000


@dataclass(frozen=True)
class Labeller:
    """Votes bad (0) or good (1) by bounds on a metric; ``above`` says which side of them is good."""

    metric: str
    bad: float
    good: float
    above: bool

    def vote(self, x: Column) -> Column:
        if self.above:
            return F.when(x <= self.bad, 0).when(x >= self.good, 1).otherwise(-1)
        return F.when(x >= self.bad, 0).when(x <= self.good, 1).otherwise(-1)


LABELLERS = (
    Labeller("n_words", bad=15, good=60, above=True),
    Labeller("symbol_word_ratio", bad=0.2, good=0.05, above=False),
    Labeller("repeat_word_ratio", bad=0.15, good=0.02, above=False),
    Labeller("stop_word_ratio", bad=0.02, good=0.10, above=True),
    Labeller("upper_letter_ratio", bad=0.4, good=0.1, above=False),
    Labeller("dup_line_ratio", bad=0.3, good=0.05, above=False),
    Labeller("letter_ratio", bad=0.7, good=0.9, above=True),
)


def votes(text: Column) -> Column:
    """The votes of all labellers as one number: digit j (base 3) is labeller j's vote plus one."""

    def packed(m: Column) -> Column:
        by_name = ratios(m)
        return sum((F.lit(3**j) * (lab.vote(by_name[lab.metric]) + 1) for j, lab in enumerate(LABELLERS)), F.lit(0)).cast("int")

    return let(metrics(text), packed)


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Rows of -1, 0, 1 of vote numbers."""
    return patterns.reshape(-1, 1) // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class WeakLabels:
    """Log odds of good: ``prior`` plus one number per labeller and vote."""

    prior: float
    odds: np.ndarray  # labeller, vote

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each vote number."""
        found, table = unpacked(patterns), np.hstack([np.zeros((len(self.odds), 1)), self.odds])
        total = self.prior + sum(table[j, found[:, j] + 1] for j in range(len(self.odds)))
        return 1 / (1 + np.exp(-total))


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Accuracies of the labellers from counted vote patterns (rows of -1, 0, 1)."""
    if not len(patterns):
        return WeakLabels(0.0, np.zeros((len(LABELLERS), 2)))
    voted = patterns >= 0
    agree = np.where(voted.any(1), (patterns == 1).sum(1) / np.maximum(voted.sum(1), 1), 0.5)
    p = np.clip(agree, 0.05, 0.95)  # begin with the share of good votes
    for _ in range(rounds):
        good, bad = n * p, n * (1 - p)
        prior = np.log((good.sum() + 1) / (bad.sum() + 1))
        odds = np.zeros((patterns.shape[1], 2))
        for j in range(patterns.shape[1]):
            for v in (0, 1):
                own = patterns[:, j] == v
                any_vote = voted[:, j]
                odds[j, v] = np.log((good[own].sum() + 1) / (good[any_vote].sum() + 2)) - np.log((bad[own].sum() + 1) / (bad[any_vote].sum() + 2))
        margin = prior + sum(np.where(patterns[:, j] == v, odds[j, v], 0.0) for j in range(patterns.shape[1]) for v in (0, 1))
        new = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return WeakLabels(float(prior), odds)


def weak_labels(voted: DataFrame) -> tuple[WeakLabels, int]:
    """Labellers fitted on the vote patterns of all documents, and the number of documents."""
    rows = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** 7 at most
    rows.sort(key=lambda r: r["pattern"])
    n = np.array([r["n"] for r in rows], float)
    return expectation_maximisation(unpacked(np.array([r["pattern"] for r in rows], np.int64)), n), int(n.sum())


def hash_bound(n: int, wanted: int) -> int:
    """The signed 64-bit hash below which about ``wanted`` of ``n`` rows lie, however many there are."""
    return min(2**63 - 1, -(2**63) + 2**64 * wanted // max(n, 1))


def sampled(voted: DataFrame, n: int) -> DataFrame:
    """The ``MAX_SAMPLE`` rows with the smallest hashes (all, if fewer)."""
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    keyed = voted.select("doc_id", "text", "pattern", place.alias("place"))
    near = keyed.where(F.col("place") <= hash_bound(n, 2 * MAX_SAMPLE))  # so that few rows are sorted
    ordered = near if near.limit(1).count() else keyed  # rows that are all alike share one hash
    return ordered.orderBy("place", "doc_id", "text").limit(MAX_SAMPLE)


def fit_scorer(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, classes weighted equally, by accelerated gradient steps."""
    if not len(x):
        return np.zeros(ngrams.DIMS), 0.0
    target = target.astype(np.float32)
    weight = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3)).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = seen = np.zeros(x1.shape[1], np.float32)
    rate = np.float32(4.0 / (weight * np.einsum("ij,ij->i", x1, x1)).mean())
    for k in range(steps):
        ahead = w + np.float32(k / (k + 3)) * (w - seen)
        p = 1 / (1 + np.exp(-(x1 @ ahead)))
        seen, w = w, ahead - rate * ((weight * (p - target)) @ x1 / np.float32(len(x)) + np.float32(l2) * ahead)
    return w[:-1], float(w[-1])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (of the votes), score (of the scorer) and good (score of at least one half)."""
    voted = written(docs.select("doc_id", "text", votes(F.col("text")).alias("pattern")), "quality-votes")
    labels, n = weak_labels(voted)
    sample = sampled(voted, n).select(F.col("pattern").alias("target"), "text")
    rows = sample.mapInArrow(ngrams.sparse, f"target int, {ngrams.SPARSE}").collect()  # MAX_SAMPLE rows
    rows.sort(key=lambda r: (r["target"], bytes(r["places"]), bytes(r["values"])))
    w, bias = fit_scorer(ngrams.dense(rows), labels.posteriors(np.array([r["target"] for r in rows], np.int64)))
    weights = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # DIMS numbers

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = labels.posteriors(batch.column("pattern").to_numpy().astype(np.int64))
            for at, x in ngrams.features(batch.column("text")):
                s = 1 / (1 + np.exp(-(x @ weights.value + bias)))
                own = batch.column("doc_id").slice(at, len(x)), pa.array(posterior[at : at + len(x)]), pa.array(s.astype(np.float64))
                yield pa.RecordBatch.from_arrays(list(own), names=["doc_id", "posterior", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return voted.mapInArrow(of, f"doc_id {kind}, posterior double, score double").withColumn("good", F.col("score") >= 0.5)
