"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features are hashes of single words and of pairs of neighbours, in two views:
the lower-case word, and its shape (letters as a or A, runs shortened). A score
is the logistic of a sparse dot product, the sum of the weights of a text's
n-grams over the root of their number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlark.llm.common import Tokens, hash_words, least_hashes, map_batches, pair, with_fields

BUCKET_BITS = 18


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram of the texts, in no special order."""
    tokens = Tokens(texts, lower=False)
    words = tokens.words
    shape = pc.replace_substring_regex(words, r"\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"[0-9]+", "0")
    rows = tokens.row_of()
    found, at = [], []
    for salt, view in ((1, hash_words(pc.utf8_lower(words))), (2, hash_words(shape))):
        one = pair(view, np.full(len(view), salt, np.uint64))[tokens.codes]
        two = pair(one[:-1], one[1:])
        same = rows[:-1] == rows[1:]
        found += [one, two[same]]
        at += [rows, rows[:-1][same]]
    return (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(at)


def scale(counts: np.ndarray) -> np.ndarray:
    """What a row's sum of weights is multiplied with."""
    return 1 / np.sqrt(np.maximum(counts, 1))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        found, at = buckets(texts)
        n = len(texts)
        dots = np.bincount(at, self.weights[found], n) * scale(np.bincount(at, minlength=n))
        return 1 / (1 + np.exp(-np.clip(dots + self.bias, -50, 50)))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader state, one place a bucket and a last one for the bias."""

    alpha: float
    beta: float
    l1: float
    l2: float

    def __post_init__(self):
        self.z, self.n = np.zeros(2**BUCKET_BITS + 1), np.zeros(2**BUCKET_BITS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
        g = (p - label) * x
        more = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - more * w
        self.n[at] += g * g


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label", learners: int = 8, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> QualityModel:
    """FTRL on each of ``learners`` parts of the rows; the model is the mean of their weights.

    Rows with a null label teach nothing; a null text is empty. Parts go by
    a hash of the key, so that copies of a text spread over them. The rows are a bounded sample
    (see ``labelled_sample``), so a part fits a task; what comes to the driver are
    at most 2**BUCKET_BITS + 1 mean weights. No rows at all: every score is 0.5.
    """
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(learners)).alias("learner")).where("label is not null")

    def run(rows: pa.Table) -> pa.Table:
        held = []
        for batch in rows.to_batches():
            found, at = buckets(batch.column("text"))
            order = np.argsort(at, kind="stable")
            found, ends = found[order], np.cumsum(np.bincount(at, minlength=batch.num_rows))
            for i, y in enumerate(batch.column("label").to_pylist()):
                own, counts = np.unique(found[(ends[i - 1] if i else 0) : ends[i]], return_counts=True)
                held.append((np.append(own, 2**BUCKET_BITS), np.append(counts * scale(counts.sum()), 1.0), y))
        state, order = Ftrl(alpha, beta, l1, l2), np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(held)):
                state.learn(*held[i])
        w = state.weights()
        at = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w[at])})

    parts = rows.groupBy("learner").applyInArrow(run, "at bigint, w double")
    got = parts.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    weights, bias = np.zeros(2**BUCKET_BITS), 0.0
    if len(got):
        n = int(got["n"].max())  # each learner that had rows sends the bias
        own = got["at"].to_numpy() < 2**BUCKET_BITS
        weights[got["at"].to_numpy()[own]] = got["w"].to_numpy()[own] / n
        bias = float(got["w"].to_numpy()[~own].sum() / n)
    return QualityModel(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row with score and predicted; columns of those names are replaced. A null text is scored as empty."""
    rest = docs.drop("score", "predicted")

    def run(batch: pa.RecordBatch) -> pa.Table:
        found = model.scores(batch.column(text))
        out = pa.Table.from_batches([batch])
        return out.append_column("score", pa.array(found)).append_column("predicted", pa.array((found >= threshold).astype(np.int32)))

    return map_batches(rest, run, with_fields(rest, "score double, predicted int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", max_rows: int = 8192) -> DataFrame:
    """Key, text and label of at most ``max_rows`` labelled documents, those whose key hashes least.

    The picked keys are few by that bound, so they go to every task. A key
    with several labels is left out where they differ and counts once where not.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_top")).where("label = _top")
    picked = least_hashes(one.select(key, "label", F.xxhash64(key).alias("_h")), "_h", max_rows).select(key, "label")
    return docs.select(key, "text").join(F.broadcast(picked), key)
