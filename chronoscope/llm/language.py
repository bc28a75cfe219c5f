"""Language identification in two steps: the family first, then one-versus-one linear support vector
machines between the languages of that family.

Features are hashed words and byte n-grams (1 to 3 bytes), as relative frequencies. The family step
is a set of one-versus-rest linear machines; within the family, every pair of languages has a machine
of its own and the language with most votes wins (ties: larger sum of margins, then name). All are
trained with the hinge loss by adaptive subgradient steps in numpy, on a bounded sample
(SAMPLE_PER_LANGUAGE documents of each language, a documented parameter).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import hashed_features, run_sums, text_parts
from .training import bounded_sample, held_out, named_once, sample_features

BITS = 16
SIZES = (1, 2, 3)
EPOCHS = 8
SAMPLE_PER_LANGUAGE = 1000
SCALE = 30.0
DECAY = 1e-5
STEEPNESS = 2.0

# Families of common language codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def fit_svm(ids: list[np.ndarray], freq: list[np.ndarray], sign: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Linear machine, hinge loss, per-bucket adaptive steps; classes weigh alike. Returns the average
    of the weights over the last half of the epochs."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    b, b2, kept, kept_b, n_kept = 0.0, 1.0, np.zeros(1 << BITS), 0.0, 0
    share = {s: len(sign) / (2 * max(1, (sign == s).sum())) for s in (-1, 1)}
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(sign)):
            x, at = freq[i] * SCALE, ids[i]
            if sign[i] * (w[at] @ x + b) < 1:
                g = -sign[i] * share[int(sign[i])] * x + DECAY * w[at]
                g2[at] += g * g
                w[at] -= 0.5 * g / np.sqrt(g2[at])
                b2 += 1
                b += 0.1 * sign[i] * share[int(sign[i])] / b2 ** 0.5
        if epoch >= EPOCHS // 2:
            kept += w
            kept_b += b
            n_kept += 1
    return kept / n_kept * SCALE, kept_b / n_kept


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        """weights: one row per machine: the families in order (none if only one), then the pairs of
        each family in order."""
        self.langs, self.weights, self.bias = langs, weights, bias
        self.families = sorted({family(x) for x in langs})
        self.members = {f: [x for x in langs if family(x) == f] for f in self.families}

    def machines(self) -> list[tuple]:
        own = [("family", f) for f in self.families] if len(self.families) > 1 else []
        return own + [("pair", a, b) for f in self.families for a, b in combinations(self.members[f], 2)]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        machines = self.machines()
        margin, n = np.zeros((len(machines), len(texts))), np.zeros(len(texts))
        for bucket, offsets in hashed_features(texts, SIZES, BITS):
            for k in range(len(machines)):
                margin[k] += run_sums(self.weights[k][bucket], offsets)
            n += np.diff(offsets)
        margin = margin / np.maximum(n, 1) + self.bias[:, None]
        sure = 1 / (1 + np.exp(-STEEPNESS * np.clip(margin, -20, 20)))
        if len(self.families) > 1:
            rows = [k for k, m in enumerate(machines) if m[0] == "family"]
            odds = sure[rows] + 1e-12
            chosen, chance = margin[rows].argmax(axis=0), odds.max(axis=0) / odds.sum(axis=0)
        else:
            chosen, chance = np.zeros(len(texts), int), np.ones(len(texts))
        best, score = [""] * len(texts), np.zeros(len(texts))
        for f, name in enumerate(self.families):
            members, docs = self.members[name], np.flatnonzero(chosen == f)
            votes, sums, odds = (np.zeros((len(members), len(docs))) for _ in range(3))
            for k, m in enumerate(machines):
                if m[0] == "pair" and m[1] in members and family(m[1]) == name:
                    a, b = members.index(m[1]), members.index(m[2])
                    votes[a] += margin[k, docs] > 0
                    votes[b] += margin[k, docs] <= 0
                    sums[a] += margin[k, docs]
                    sums[b] -= margin[k, docs]
                    odds[a] += sure[k, docs]
                    odds[b] += 1 - sure[k, docs]
            win = np.lexsort((sums, votes), axis=0)[-1] if len(members) > 1 else np.zeros(len(docs), int)
            part = odds[win, np.arange(len(docs))] / (len(members) - 1) if len(members) > 1 else np.ones(len(docs))
            for j, d in enumerate(docs):
                best[d] = members[win[j]]
            score[docs] = chance[docs] * part
        return best, np.clip(score, 0, 1)


def train(ids, freq, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    shape = Model(langs, np.zeros((0, 1)), np.zeros(0))
    y = np.array(labels, object)
    groups = np.array([family(x) for x in labels], object)
    weights, bias = [], []
    for k, m in enumerate(shape.machines()):
        at = np.arange(len(y)) if m[0] == "family" else np.flatnonzero((y == m[1]) | (y == m[2]))
        sign = np.where((groups[at] == m[1]) if m[0] == "family" else (y[at] == m[1]), 1, -1)
        w, b = fit_svm([ids[i] for i in at], [freq[i] for i in at], sign, seed=k)
        weights.append(w)
        bias.append(b)
    return Model(langs, np.array(weights).reshape(len(weights), 1 << BITS), np.array(bias))


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from text and non-null lang of the documents that are not held out and whose id stands in one
    row only."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sample, _ = bounded_sample(known.select("doc_id", "lang").join(named_once(docs), "doc_id", "left_semi"), "lang", per_language)
    return train(*sample_features(known, sample, "lang", SIZES, BITS))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to every row; und and 0.0 where the text is null or has no letter.
    Columns of these names are replaced; others pass through. No shuffle."""
    kept = docs.drop("lang_pred", "score")
    names = kept.columns
    spelled = kept.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    langs, weights, bias = model.langs, model.weights, model.bias
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(langs, weights, bias)
        for batch in batches:
            for start, stop, texts in text_parts(batch.column("text")):
                part = batch.slice(start, stop - start)
                lang, score = m.predict(texts)
                letters = part.column("_letters").to_pylist()
                lang = [x if ok else "und" for x, ok in zip(lang, letters)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*names, "lang_pred", "score"])

    return spelled.mapInArrow(run, schema)


def languages_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit_language(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
