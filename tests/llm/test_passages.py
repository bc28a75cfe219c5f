import hashlib
import random
import re

import numpy as np
import pytest

from chronoscope.llm import passages


def brute(rows):
    """Distinct (doc_id, text) in order; first start of every window of 20 words."""
    seen, out = set(), {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for j in range(len(w) - passages.WINDOW + 1):
            key = tuple(w[j:j + passages.WINDOW])
            if key in seen:
                gone[j:j + passages.WINDOW] = [True] * passages.WINDOW
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(docs):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.without_repeats(docs).collect()}


def planted():
    """Passages shared whole, shifted, with single words changed, and repeated inside a document."""
    r = random.Random(9)
    word = lambda: f"v{r.randrange(60)}"
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 40, 90)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(r.randrange(4)):
            parts += [word() for _ in range(r.randrange(30))]
            p = list(r.choice(shared))
            a = r.randrange(3)
            p = p[a:len(p) - r.randrange(3)]
            if r.random() < 0.4:
                p[r.randrange(len(p))] = word()
            parts += p * r.choice([1, 1, 1, 2])
        rows.append((i, " \n".join(parts) if i % 2 else " ".join(parts)))
    return rows


@pytest.mark.parametrize("frequent, copies", [(10**9, 10**9), (3, 10**9), (10**9, 2), (3, 2)])
def test_planted_against_brute_force(spark, monkeypatch, frequent, copies):
    """By the automata alone, with most anchors taken as frequent, and with all copies as such."""
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "FREQUENT", frequent)
    monkeypatch.setattr(passages, "COPIES", copies)
    rows = planted()
    rows += [(1000 + k, rows[k % 20][1]) for k in range(50)] + [(2000 + k, "ten words only") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs) == brute(rows)


def test_documents_against_brute_force(documents, texts):
    assert result(documents) == brute(sorted(texts.items()))


def test_automaton_statistics():
    r = random.Random(4)
    for _ in range(40):
        pieces = [[r.randrange(3) for _ in range(r.randrange(1, 15))] for _ in range(4)]
        a = passages.SuffixAutomaton()
        for p in pieces:
            a.add(p)
        text = [r.randrange(3) for _ in range(25)]
        covered = np.zeros(25, bool)
        for j in range(25 - 3):
            if any(p[k:k + 4] == text[j:j + 4] for p in pieces for k in range(len(p) - 3)):
                covered[j:j + 4] = True
        got = np.zeros(25, bool)
        for x, y in a.repeats(text, 4):
            got[x:y] = True
        assert (got == covered).all()


def test_edges(edge_docs, no_docs):
    rows = passages.without_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[1]["n_removed"] == 0
    twos = [r for r in rows if r["doc_id"] == 2]
    assert len(twos) == 2 and all(r["n_removed"] == r["n_words"] == 120 for r in twos)  # one document, a copy of 1
    assert got[3]["n_removed"] > 100
    assert got[5]["n_words"] == 0 and got[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["n_words"] == 30_000
    assert passages.without_repeats(no_docs).collect() == []
