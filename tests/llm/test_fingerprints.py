import hashlib
import math

import numpy as np

from chronoscope.llm import fingerprints as f
from chronoscope.llm.textbatch import Texts


def one(text):
    raw = text.encode()
    return f.fingerprints(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]


def brute(rows):
    out = {}
    rows = sorted(rows)
    for i, (doc_id, s) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = s[:len(s) - len(s) // 2] + following[:len(s) // 2]
        a, b, c = one(s), one(edited), one(following)
        near = lambda x, y: 1.0 if (x == y).all() else max(0.0, math.cos(math.pi * int(np.unpackbits(x ^ y).sum()) / f.BITS))
        out[doc_id] = (len(s), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), near(a, b), near(a, c))
    return out


def test_documents_against_brute_force(documents, texts):
    got = {r[0]: tuple(r)[1:] for r in f.edited_fingerprints(documents).collect()}
    expected = brute(list(texts.items()))
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k][:4] == expected[k][:4]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k][4:], expected[k][4:]))
    edited, following = (np.mean([g[i] for g in got.values()]) for i in (4, 5))
    assert edited > following + 0.3


def test_votes_are_weighted_signs():
    raw = b"alpha beta gamma delta"
    texts = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    terms, _ = texts.shingles(f.TERM_WORDS)
    votes = np.zeros(f.BITS)
    for t, w in zip(terms, (14, 14)):
        both = np.array([t, f.mix64(np.array([t]) ^ f.SECOND)[0]], np.uint64)
        votes += w * (np.unpackbits(both.view(np.uint8)).astype(int) * 2 - 1)
    assert (np.unpackbits(one("alpha beta gamma delta")) == (votes > 0)).all()


def test_edges(edge_docs, no_docs):
    rows = f.edited_fingerprints(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert f.edited_fingerprints(no_docs).collect() == []
    single = edge_docs.where("doc_id = 1")
    r = f.edited_fingerprints(single).collect()[0]
    assert r["near_next"] == 1.0
    plain = f.fingerprint_documents(edge_docs)
    assert plain.columns[-1] == "fingerprint" and plain.count() == edge_docs.count()


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (12, 16), np.uint8)
    prints = []
    for i in range(300):
        x = np.unpackbits(base[i % 12].copy())
        x[rng.choice(128, i % 6, replace=False)] ^= 1
        prints.append(bytes(np.packbits(x)).hex())
    rows = list(enumerate(prints)) + [(300, prints[0]), (301, None)]
    index = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    queries = index.where("doc_id % 20 = 0")
    got = {tuple(r) for r in f.within_radius(queries, index, 3).collect()}
    expected = set()
    for a, x in rows:
        for b, y in rows:
            if a % 20 == 0 and x and y:
                d = (int(x, 16) ^ int(y, 16)).bit_count()
                if d <= 3:
                    expected.add((a, b, d))
    assert got == expected
