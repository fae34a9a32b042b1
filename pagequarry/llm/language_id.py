"""Language identification by family, then by one-versus-one linear SVMs within the family.

Features are hashed byte 2- to 4-grams of the whole text. Training uses at
most ``MAX_PER_LANG`` labelled training documents of *every* language, those
with the smallest hashes of doc_id and text. Families come from the data:
languages are merged by average cosine similarity of their mean features down
to about the square root of their number. One SVM per pair of families decides
the family (from ``MAX_PER_FAMILY`` documents of either), one per pair of its
languages the language; where there are more than two, wins count, then margins.
Every duel is fitted in a Spark task of its own, with its own rows alone; the
driver holds one mean (32 kB) a language and one weight vector (32 kB) a duel,
of which L languages have about ``L ** 1.5 / 2``.

Defined results: null text, or text without a letter, is ``und`` with score 0;
with no labelled training document every text is ``und``; a null doc_id is
not held out; repeated rows are predicted alike, and ties fall to the language
first in order; texts of any length are read whole; extra columns are ignored,
whatever their names; an empty table gives an empty result. ``lang`` is read for
training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm import ngrams
from pagequarry.llm.store import written

MAX_PER_LANG = 300
MAX_PER_FAMILY = 1200
#: Languages whose counts (a name and two numbers each) may be broadcast; beyond it the join shuffles.
BROADCAST_LANGS = 100_000
SHARPNESS = 4.0


@dataclass
class Duels:
    """A linear SVM for each pair of ``names``; positive margins favour the first."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row and a confidence of at least one half."""
        wins, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights.T + self.bias
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            wins[:, a] += m >= 0
            wins[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
        best = (wins + 1e-3 * np.tanh(total)).argmax(1)
        least = np.full(len(x), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = np.abs(margins[:, k])
            least = np.where((best == a) | (best == b), np.minimum(least, m), least)
        return best, 1 / (1 + np.exp(-SHARPNESS * least))


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Linear hinge-loss SVM by dual coordinate descent over sparse rows (places, values); the bias is a constant feature."""
    w, bias, alpha = np.zeros(ngrams.DIMS), 0.0, np.zeros(len(rows))
    norm = [float(v @ v) + 1.0 for _, v in rows]
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            places, values = rows[i]
            gradient = y[i] * (w[places] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[places] += step * values
                bias += step
                alpha[i] = new
    return w, bias


def families(means: np.ndarray) -> list[list[int]]:
    """Languages merged by average similarity down to about the root of their number."""
    groups: list[list[int]] = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    total, size = (unit @ unit.T).astype(np.float64), np.ones(len(means))  # summed similarity of each pair of groups
    alive = len(groups)
    upper = np.triu(np.ones(total.shape, bool), 1)
    while alive > max(1, int(np.ceil(np.sqrt(len(means))))):
        mean = np.where(upper, total / np.outer(size, size), -np.inf)
        a, b = np.unravel_index(int(mean.argmax()), mean.shape)
        groups[a] = sorted(groups[a] + groups[b])
        groups[b] = []
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a] += size[b]
        upper[b] = upper[:, b] = False
        alive -= 1
    return sorted(g for g in groups if g)


@dataclass
class Model:
    family: Duels
    members: list[Duels]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, sure = self.family.decide(x)
        names, score = [""] * len(x), np.zeros(len(x))
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                best, s = own.decide(x[rows])
                score[rows] = sure[rows] * s
                for r, b in zip(rows, best, strict=True):
                    names[r] = own.names[b]
        return names, score


def sampled(labelled: DataFrame) -> DataFrame:
    """lang, nth and sparse features of at most ``MAX_PER_LANG`` documents of each language."""
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", place.alias("place"))
    counts = written(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")), "lang-counts")
    if counts.count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    # about 2 * MAX_PER_LANG rows of a language, and always its first, reach the window
    few = (F.col("place") / F.lit(2.0**64) + 0.5 <= F.lit(2.0 * MAX_PER_LANG) / F.col("n")) | (F.col("place") == F.col("least"))
    first = Window.partitionBy("lang").orderBy("place")
    chosen = usable.join(counts, "lang").where(few).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= MAX_PER_LANG)
    rows = chosen.select(F.struct("lang", "nth").alias("target"), "text").mapInArrow(ngrams.sparse, f"target struct<lang:string,nth:int>, {ngrams.SPARSE}")
    return written(rows.select("target.lang", "target.nth", "places", "values"), "lang-sample")


def mean_features(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of one language's at most ``MAX_PER_LANG`` rows."""
    total = np.zeros(ngrams.DIMS)
    for places, values in zip(pdf["places"], pdf["values"], strict=True):
        total[np.frombuffer(places, np.uint16)] += np.frombuffer(values, np.float32)
    return pd.DataFrame({"lang": [key[0]], "mean": [(total / len(pdf)).astype(np.float32).tobytes()]})


def fit_duel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights of one duel from the rows of both sides."""
    pdf = pdf.sort_values(["side", "nth", "lang"], kind="stable")
    rows = [(np.frombuffer(p, np.uint16), np.frombuffer(v, np.float32).astype(np.float64)) for p, v in zip(pdf["places"], pdf["values"], strict=True)]
    w, bias = svm(rows, pdf["side"].to_numpy(np.float64))
    return pd.DataFrame({"duel": [key[0]], "weights": [w.astype(np.float32).tobytes()], "bias": [bias]})


def train(labelled: DataFrame) -> Model | None:
    """A model from doc_id, text and non-null lang."""
    spark, sample = labelled.sparkSession, sampled(labelled)
    means = sample.groupBy("lang").applyInPandas(mean_features, "lang string, mean binary").collect()  # one row a language
    if not means:
        return None
    means.sort(key=lambda r: r["lang"])
    langs = [r["lang"] for r in means]
    groups = families(np.array([np.frombuffer(r["mean"], np.float32) for r in means]))
    entries = []  # language, duel, side, rows of the language that take part
    for f, group in enumerate(groups):
        share = -(-MAX_PER_FAMILY // len(group))
        for i in group:
            entries += [(langs[i], f"lang {min(i, j)} {max(i, j)}", 1.0 if i < j else -1.0, MAX_PER_LANG) for j in group if j != i]
            entries += [(langs[i], f"family {min(f, g)} {max(f, g)}", 1.0 if f < g else -1.0, share) for g in range(len(groups)) if g != f]
    fitted = {}
    if entries:
        roles = spark.createDataFrame(entries, "lang string, duel string, side double, most int")
        fights = sample.join(roles, "lang").where("nth <= most").select("duel", "side", "lang", "nth", "places", "values")
        rows = fights.groupBy("duel").applyInPandas(fit_duel, "duel string, weights binary, bias double").collect()  # one row a duel
        fitted = {r["duel"]: (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in rows}

    def duels(kind: str, members: list[int], names: list[str]) -> Duels:
        pairs = list(combinations(range(len(members)), 2))
        found = [fitted[f"{kind} {members[a]} {members[b]}"] for a, b in pairs]
        return Duels(names, pairs, np.array([w for w, _ in found], np.float32).reshape(len(pairs), ngrams.DIMS), np.array([b for _, b in found]))

    top = list(range(len(groups)))
    return Model(duels("family", top, [str(g) for g in top]), [duels("lang", g, [langs[i] for i in g]) for g in groups])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vector of DIMS numbers a duel

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            for at, x in ngrams.features(batch.column("text")):
                names, score = shared.value.predict(x) if shared.value else (["und"] * len(x), np.zeros(len(x)))
                ok = lettered[at : at + len(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(x)),
                        pa.array([n if k else "und" for n, k in zip(names, ok, strict=True)]),
                        pa.array(np.where(ok, score, 0.0).astype(np.float64)),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id):
    """Documents kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, predict all."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
