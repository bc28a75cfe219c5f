import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from chronoscope.llm import mixing


def brute_targets(sizes):
    """Share by weight, cap at three times, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in above}


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, source):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    assert len(rows) == len(source)
    by_id = {k: s for k, s, _ in source}
    for _, s, t in source:
        sizes[s] += n_words(t)
    expected = brute_targets(sizes)
    for r in rows:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - expected[s]) < 1e-6 * max(1, expected[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    return taken, expected


def test_documents(documents):
    source = [tuple(r) for r in documents.select("doc_id", "source", "text").collect()]
    rows = mixing.mixed_words(documents).collect()
    taken, expected = check(rows, source)
    assert abs(sum(taken.values()) - sum(expected.values())) < 0.05 * sum(expected.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed_words(documents.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_many_blocks_and_levels(spark, monkeypatch):
    """Small blocks: leaves, two class levels and the pool; a source is off by less than one document."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    r = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", " ".join(["w"] * r.choice([1, 2, 3, 40, 41, 300]))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, expected = check(mixing.mixed_words(docs).collect(), rows)
    for s in expected:
        assert abs(taken[s] - expected[s]) <= 300, s  # the largest document


def test_small_sources_go_through_pairs(spark):
    """Sources of fifty documents: leaves leave one unit each at most, and the source is off by less than one
    document."""
    rows = [(i, f"s{i % 5}", " ".join(["w"] * (10 + i % 3))) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, expected = check(mixing.mixed_words(docs).collect(), rows)
    assert all(abs(taken[s] - expected[s]) <= 12 for s in expected)
    mass, words = [0.3] * 50, [10.0] * 50
    mixing.round_pairwise(mass, words, list(range(50)))
    assert sum(0 < m < 1 for m in mass) <= 1 and abs(sum(mass) - 15) < 1e-6


def test_one_capped_source(spark):
    rows = [(1, "a", "x " * 5), (2, "b", "x " * 1000), (3, "c", "x " * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r["doc_id"]: r for r in mixing.mixed_words(docs).collect()}
    assert out[1]["target"] == 15.0 and out[1]["taken"] == 15


def test_rounding_leaves_expectations_alone():
    r = random.Random(3)
    words = [float(r.choice([3, 4, 5, 9])) for _ in range(7)]
    for rounding in (mixing.round_pairwise, mixing.round_pool):
        total, runs = [0.0] * 7, 4000
        for k in range(runs):
            mass = [0.3] * 7
            rounding(mass, words, [r.getrandbits(60) for _ in range(7)])
            assert sum(0.0 < m < 1.0 for m in mass) <= (1 if rounding is mixing.round_pairwise else 0)
            total = [a + b for a, b in zip(total, mass)]
        assert all(abs(t / runs - 0.3) < 0.04 for t in total)


def test_edges(edge_docs, no_docs):
    rows = mixing.mixed_words(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
    copies = mixing.mixed_copies(edge_docs)
    assert copies.columns == edge_docs.columns
    whole = mixing.mix_documents(edge_docs.select(F.struct("*").alias("doc"), "source", "text")).agg(F.sum("copies")).first()[0]
    assert copies.count() == whole
    assert mixing.mixed_words(no_docs).collect() == [] and mixing.mixed_copies(no_docs).collect() == []
