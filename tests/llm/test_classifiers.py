import random
import zlib

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoscope.llm import language, quality, textbatch, training

FULL = (1 << 64) - 1
TEXTS = ["", "one", "  two\twords \n", "été naïve 😀 中文字", "Repeat repeat repeat the the", "a", "ab cd", "x" * 50, "word," * 30, "über Straße für"]


def mixed(x):
    x ^= x >> 30
    x = x * int(textbatch.MIX_1) & FULL
    x ^= x >> 27
    x = x * int(textbatch.MIX_2) & FULL
    return x ^ x >> 31


def plain_buckets(text, sizes, bits, characters):
    """Every feature's bucket, one at a time."""
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = mixed(sum((b + 1) * pow(textbatch.BASE, i, 1 << 64) for i, b in enumerate(w.encode())) & FULL)
        out.append(((h ^ int(textbatch.MIX_1)) * textbatch.BASE & FULL) >> (64 - bits))
    units = [c.encode() for c in text] if characters else [bytes([b]) for b in text.encode()]
    space = [u in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") for u in units]
    for size in sizes:
        for i in range(len(units) - size + 1):
            if any(space[i + 1:i + size - 1]):
                continue
            code = 0
            for j in range(size):
                value = 0x20 if space[i + j] else int.from_bytes(units[i + j], "big")
                code = mixed(code ^ value) if characters else code | value << 8 * j
            out.append((((code * textbatch.BASE + size) & FULL) * int(textbatch.MIX_2) & FULL) >> (64 - bits))
    return out


def batches():
    return [t for _, _, t in textbatch.text_parts(pa.array(TEXTS))]


def test_quality_scores_by_a_plain_scorer():
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    model = quality.Model(weights, 0.3)
    got = np.concatenate([model.scores(t) for t in batches()])
    for text, score in zip(TEXTS, got):
        found = plain_buckets(text, quality.SIZES, quality.BITS, True)
        mean = sum(weights[b] for b in found) / max(1, len(found))
        assert abs(score - 1 / (1 + np.exp(-(0.3 + mean)))) < 1e-9, text


def test_languages_by_a_plain_scorer():
    """Margins one by one: the family of the largest, then votes of the pairs in it."""
    shape = language.Model(["de", "en", "es", "fr", "it"], np.zeros((0, 1)), np.zeros(0))
    r = np.random.default_rng(2)
    machines = shape.machines()
    model = language.Model(shape.langs, r.normal(size=(len(machines), 1 << language.BITS)), r.normal(size=len(machines)) * 0.1)
    got = [x for t in batches() for x in zip(*model.predict(t))]
    for text, (lang, score) in zip(TEXTS, got):
        found = plain_buckets(text, language.SIZES, language.BITS, False)
        margin = [sum(w[b] for b in found) / max(1, len(found)) + c for w, c in zip(model.weights, model.bias)]
        sure = [1 / (1 + np.exp(-language.STEEPNESS * m)) for m in margin]
        chosen = max((k for k, m in enumerate(machines) if m[0] == "family"), key=lambda k: margin[k])
        chance = sure[chosen] / sum(s for s, m in zip(sure, machines) if m[0] == "family")
        members = model.members[machines[chosen][1]]
        pairs = [(k, m[1], m[2]) for k, m in enumerate(machines) if m[0] == "pair" and m[1] in members]

        def votes(x):
            return sum(margin[k] > 0 if a == x else margin[k] <= 0 for k, a, b in pairs if x in (a, b)), sum(margin[k] if a == x else -margin[k] for k, a, b in pairs if x in (a, b))

        best = max(members, key=votes)
        odds = sum(sure[k] if a == best else 1 - sure[k] for k, a, b in pairs if best in (a, b))
        assert lang == best and abs(score - chance * odds / (len(members) - 1)) < 1e-9, text


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def corpus(n):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(r.choice(["the", "an", "in", "er", "on"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 80))]
        good = i % 4 != 0
        rows.append((i, " ".join(w if good else [x + r.choice(["!!", "$$$", "###"]) for x in w])))
        if i % 3:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_of_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 600
    for r in out:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    test = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in test) / len(test) > 0.97


def test_quality_never_sees_held_out_labels(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lied = [(i, 1 - q if held(i) else q) for i, q in labels]
    score = lambda y: {r["doc_id"]: r["score"] for r in quality.quality_of_documents(docs, spark.createDataFrame(y, "doc_id long, quality int")).collect()}
    assert score(labels) == score(lied)


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (11, 1), (3, 0), (10, 1), (-5, 1)], "doc_id long, quality int")
    out = quality.quality_of_documents(edge_docs, labels).collect()
    assert len(out) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[4] == by_id[5]  # without a feature: the bias alone
    none = labels.limit(0)
    assert {r["score"] for r in quality.quality_of_documents(edge_docs, none).collect()} == {0.5}
    assert quality.quality_of_documents(no_docs, labels).collect() == []
    scored = quality.score_quality(edge_docs, quality.fit_quality(edge_docs, none))
    assert set(scored.columns) == set(edge_docs.columns)


def test_sample_is_bounded_and_reproducible(spark):
    keys = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("y"))
    sample, counts = training.bounded_sample(keys, "y", 100)
    rows = sorted(map(tuple, sample.collect()))
    assert counts == {"rare": 500, "common": 4500}
    assert sum(y == "common" for _, y in rows) == 100 and sum(y == "rare" for _, y in rows) == 100
    assert rows == sorted(map(tuple, training.bounded_sample(keys.repartition(7), "y", 100)[0].collect()))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.languages_of_documents(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_has_both_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language(docs, 60)
    assert model.machines() == [("family", "germanic"), ("family", "romance"), ("pair", "de", "en"), ("pair", "es", "fr")]


def test_language_edges(spark, edge_docs, no_docs):
    out = language.languages_of_documents(edge_docs).collect()
    assert len(out) == edge_docs.count()
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (4, 5, 6, 9))
    assert got[1]["lang_pred"] != "und"
    assert language.languages_of_documents(no_docs).collect() == []
    nothing = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages_of_documents(nothing).collect()} == {"und"}


def test_ids_of_several_rows_teach_nothing(spark):
    rows = [(i, f"text number {i} of the first kind", "en") for i in range(20)] + [(3, f"{k} autre texte", "fr") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit_language(docs).langs == ["en"]
    assert training.named_once(docs).count() == 19
