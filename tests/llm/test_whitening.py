import math
import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from chronoscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, count=4):
    """(vec_id, component) -> deviation, |whitened|, explained by numpy's symmetric solver."""
    whole = [(i, np.floor(np.asarray(v, np.float32).astype(float) * 256)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in whole), default=0)
    whole = [(i, np.concatenate([x, np.zeros(dims - len(x))])) for i, x in whole]
    fit = np.array(sorted({tuple(x) for _, x in whole})).reshape(-1, dims)
    if len(fit) < 2:
        return len(fit), []
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    e, v = e[::-1], v[:, ::-1]
    used = [k for k in range(min(count, dims)) if e[k] > 1e-9 * e[0]]
    out = []
    for i, x in whole:
        d = int((((len(fit) * x - fit.sum(axis=0))) ** 2).sum())
        out += [(i, k + 1, d, abs(float((x - fit.mean(axis=0)) @ v[:, k] / math.sqrt(e[k]))), float(e[k] / e.sum())) for k in used]
    return len(fit), out


def check(spark, rows, **options):
    got = W.whitened(frame(spark, rows), **options).collect()
    n, want = brute(rows, **options)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    mine = sorted([(r.vec_id, r.component, r.deviation, abs(r.whitened), r.explained) for r in got], key=key)
    want = sorted(want, key=key)
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    for m, w in zip(mine, want):
        assert m[3] == pytest.approx(w[3], abs=1e-9, rel=1e-9) and m[4] == pytest.approx(w[4], rel=1e-9)
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)
    return got


def test_given_embeddings(spark, sf001):
    table = spark.read.parquet(f"{sf001}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = check(spark, rows)
    # one sign for all rows: values of a component correlate perfectly with their projection
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_edges(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (3, 2, 1, 0.5, 0.1)[k] for k in range(5)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0, 0.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None), (7, [-0.0] * 5)]
    check(spark, rows)
    check(spark, rows, count=2)


def test_few_vectors(spark):
    assert W.whitened(frame(spark, [])).collect() == []
    assert W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 3.0])])
    check(spark, [(1, [1.0]), (2, [-3.0])])


def test_equal_roots_are_orthogonal(spark):
    rows = [(i, [float(s * (k == j)) for k in range(3)]) for i, (j, s) in enumerate((j, s) for j in range(3) for s in (1, -1))]
    got = W.whitened(frame(spark, rows)).collect()
    assert len(got) == 18 and all(r.identity_error < 1e-9 and r.explained == pytest.approx(1 / 3) for r in got)
    by_row = Counter()
    for r in got:
        by_row[r.vec_id] += r.whitened ** 2
    assert all(v == pytest.approx(3) for v in by_row.values())


def test_large_entries_are_exact(spark):
    rows = [(1, [3e30, 1.0]), (2, [-1e12, 2.0]), (3, [1e12, -5.0]), (4, [0.0, 0.0])]
    got = W.whitened(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.identity_error < 1e-6 for r in got)
    assert all(r.deviation is None for r in got if r.vec_id == 1)
    with pytest.raises(ValueError, match="dimensions"):
        W.whitened(frame(spark, [(1, [0.0] * 1025)]))


def fraction_polynomial(m):
    """Faddeev-LeVerrier in exact fractions."""
    d = len(m)
    c, a = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[a[i][j] + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        a = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c[d - k] = -Fraction(sum(a[i][i] for i in range(d)), k)
    return [int(x) for x in c]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_is_exact(spark, d):
    r = random.Random(d)
    b = [[r.randrange(-10**6, 10**6) if r.random() < 0.7 else 0 for _ in range(d)] for _ in range(d + 1)]
    m = [[sum(row[i] * row[j] for row in b) for j in range(d)] for i in range(d)]
    assert W.characteristic_polynomial(spark, m) == fraction_polynomial(m)


def test_roots_are_isolated():
    # (z - 3)^2 (z - 1) z
    poly = [0, -9, 15, -7, 1]
    assert [W.roots_beyond(poly, a, 1) for a in (0, 1, 2, 5, 6, 7)] == [3, 3, 2, 2, 0, 0]
    for k, root in ((1, 3), (2, 3), (3, 1)):
        a, shift = W.largest_root(poly, k, 7)
        assert a < root << shift <= a + 1 and a.bit_length() >= W.BITS
    assert W.largest_root(poly, 4, 7) == (0, 0)


def test_primes():
    assert [p for p in range(60) if W.is_prime(p)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    found = W.primes_for(100)
    assert len(found) == 4 and found[0] == 2**31 - 1 and math.prod(found).bit_length() > 100


def test_null_vectors():
    m = [[2, 1, 0], [1, 2, 0], [0, 0, 3]]
    vs = np.array(W.null_vectors(m, Decimal(3), 2))
    assert np.allclose(vs @ vs.T, np.eye(2), atol=1e-15) and np.allclose(np.array(m) @ vs.T, 3 * vs.T, atol=1e-14)
