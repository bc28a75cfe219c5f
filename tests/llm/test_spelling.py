import random
import re
import zlib
from collections import Counter

import pytest

from chronoscope.llm import spelling


def slipped(doc_id, run, every=31):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run


def brute_words(rows, least=7, count=2, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            n[slipped(doc_id, run, every) if every else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= count}


def shorter(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and a in shorter(b)


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and are_near(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        if form is not None and words[form] < 10 * n:
            form = None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def result(docs, **options):
    rows = spelling.spelling_variants(docs, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n long, key string").repartition(3)


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = brute(brute_words(rows))
    assert result(documents) == want
    assert any(v[0] for v in want.values())


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert result(edge_docs) == brute(brute_words(rows))
    assert result(no_docs) == {}


@pytest.mark.parametrize("tile", [2, 3, 16, 256])
def test_dense_groups_by_brute_force(spark, tile):
    r = random.Random(3)
    base = ["aaaaaaaa", "abababab", "préfixes", "xx" + "a" * 30]
    words = set(base)
    for _ in range(400):
        w = list(r.choice(sorted(words)))
        k, c = r.randrange(len(w) + 1), r.choice("abé")
        if r.random() < 0.4:
            w.insert(k, c)
        elif k < len(w) and r.random() < 0.5:
            w[k] = c
        elif k < len(w):
            del w[k]
        words.add("".join(w))
    rows = [(i, " ".join([w] * r.choice([2, 3, 25, 300]))) for i, w in enumerate(sorted(words))]
    want = brute(brute_words(rows, every=None))
    assert result(frame(spark, rows), every=None, tile=tile) == want
    assert sum(v[4] != w and v[4] != v[0] for w, v in want.items()) > 5  # paths of more than one step
    assert max(v[2] for v in want.values()) > 5


def test_ties_cases_and_long_words(spark):
    long = "q" * 20_000
    rows = [(1, f"COLOURED coloured colored Colored Écolier écolier Écolier écolier {long} {long}z"), (1, f"{long} {long}z"), (2, None), (3, ""), (None, "seventy seventy"),
            (4, "abcdefg " * 20 + "abcdefh " * 20 + "abcdefi " * 2)]
    want = brute(brute_words(rows, every=None))
    got = result(frame(spark, rows), every=None)
    assert got == want
    assert got["abcdefi"][0] == "abcdefg"  # a tie: the first in code-point order
    assert got["coloured"] == (None, 2, 1, None, "coloured") and "Écolier" in got and got[long][2] == 1


def test_small_lengths(spark):
    rows = [(1, "a b ab ba abc aab bab cab a b ab ba abc aab bab cab")]
    assert result(frame(spark, rows), every=None, least_length=1, tile=2) == brute(brute_words(rows, least=1, every=None))


def test_slips_follow_the_document(spark):
    rows = [(i, "elephant giraffes") for i in range(400)]
    want = brute(brute_words(rows))
    assert result(frame(spark, rows)) == want and len(want) > 2
