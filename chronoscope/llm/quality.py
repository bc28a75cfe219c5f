"""Quality classifier: learned subword embeddings, averaged per document, softmax output.

Features are hashed words and character n-grams (3 and 4 code points, case kept). Each bucket has a learned
vector; a document is the mean vector of its features, and a softmax layer gives the class
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents (SAMPLE_PER_CLASS of each label, a documented parameter).
Averaging and the softmax layer are linear up to the softmax, so for scoring the layer is applied to
the vectors once (one number per bucket); a document's score then is a sum over all its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import hashed_features, run_sums, text_parts
from .training import bounded_sample, held_out, named_once, sample_features

BITS = 17
SIZES = (3, 4)
DIMENSION = 16
EPOCHS = 12
RATE = 0.6
SAMPLE_PER_CLASS = 2500
ACCEPT = 0.7


class Model:
    """Class log-odds per bucket after folding the output layer into the vectors, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float, untrained: bool = False):
        """untrained: there were no labels of both kinds to learn from."""
        self.weights, self.bias, self.untrained = weights, bias, untrained

    def scores(self, texts) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, offsets in hashed_features(texts, SIZES, BITS, characters=True):
            total += run_sums(self.weights[bucket], offsets)
            n += np.diff(offsets)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -40, 40)))


def train(ids: list[np.ndarray], freq: list[np.ndarray], labels: list[int], counts: dict, seed: int = 7) -> Model:
    """Joint SGD of vectors and softmax layer. The sample is balanced; the bias then gets the log-odds
    of the true class counts back. One class or none: a constant score (its share; 0.5 without rows)."""
    y = np.array(labels, np.int64)
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = np.log((ones + 0.5) / (zeros + 0.5))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), float(prior), untrained=True)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            if not len(ids[i]):
                continue
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = freq[i] @ vectors[ids[i]]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            bias -= rate * p
            vectors[ids[i]] -= (rate * len(ids[i]) ** 0.5) * np.outer(freq[i], back)
    shift = prior - np.log((y == 1).sum() / (y == 0).sum())
    folded = vectors @ (layer[1] - layer[0])
    return Model(folded.astype(np.float64), float(bias[1] - bias[0] + shift))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from the documents whose id is not held out and that have a label 0 or 1. A document
    labelled twice counts with its lowest label; null ids, ids of several rows, null labels and null texts
    teach nothing."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    known = known.join(named_once(docs), "doc_id")
    sample, counts = bounded_sample(known, "quality", per_class)
    return train(*sample_features(docs.where(F.col("text").isNotNull()), sample, "quality", SIZES, BITS, characters=True), counts)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score` (probability of label 1) to every row; an empty or null text gets the score of the
    bias alone. A column named score is replaced; others pass through. No shuffle."""
    kept = docs.drop("score")
    names = kept.columns
    weights, bias = model.weights, model.bias
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, bias)
        for batch in batches:
            for start, stop, texts in text_parts(batch.column("text")):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(m.scores(texts))], names=[*names, "score"])

    return kept.mapInArrow(run, schema)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) of every row."""
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
