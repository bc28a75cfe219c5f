from itertools import permutations

import numpy as np

from chronoscope.operators import surrogate as SG


def game(d, seed):
    r = np.random.default_rng(seed)
    w, pair = r.normal(size=d), r.normal(size=(d, d)) * 0.3
    return lambda z: z @ w + np.einsum("ni,ij,nj->n", z, pair, z)


def exact_shapley(f, d):
    phi = np.zeros(d)
    orders = list(permutations(range(d)))
    for order in orders:
        z = np.zeros((d + 1, d))
        for i, j in enumerate(order):
            z[i + 1:, j] = 1
        v = f(z)
        for i, j in enumerate(order):
            phi[j] += v[i + 1] - v[i]
    return phi / len(orders)


def test_enumerated_coalitions_give_exact_shapley_values():
    for seed in range(3):
        f, d = game(6, seed), 6
        masks, weights = SG.coalitions(d, 1024, 1)
        assert len(masks) == 62
        v0, v1 = f(np.array([np.zeros(d), np.ones(d)]))
        assert np.allclose(SG.kernel_values(masks, weights, f(masks), v0, v1), exact_shapley(f, d))


def test_drawn_coalitions_are_exact_on_a_linear_game_and_complete():
    r = np.random.default_rng(0)
    for d in (1, 2, 30, 64, 150):
        w = r.normal(size=d)
        masks, weights = SG.coalitions(max(d, 2), max(1024, 16 * d), 5) if d > 1 else (np.zeros((0, 1)), np.zeros(0))
        phi = SG.kernel_values(masks, weights, masks @ w, 0.0, w.sum())
        assert np.allclose(phi, w) and np.isclose(phi.sum(), w.sum())


def test_pipeline_values_are_complete(spark):
    """Sum of KernelSHAP values = p(x) - p(b) for every test sample, and close to Shapley sampling."""
    from pyspark.sql import functions as F

    from chronoscope.plans.pipeline import expected_value, prepared, relevance
    pr = prepared(spark, "/root/testdata/sf0.001", "emb")
    total = relevance(pr, "kernelshap").groupBy("noun_id").agg(F.sum("r").alias("s"))
    rows = total.join(expected_value(pr, "kernelshap"), "noun_id").join(pr.score1, "noun_id").collect()
    assert rows and all(abs(r["s"] - (r["s1"] - r["expected_value"])) < 1e-6 for r in rows)
    both = relevance(pr, "kernelshap").alias("a").join(relevance(pr, "shapleyvalue").alias("b"), ["noun_id", "feature", "t"])
    assert both.select(F.corr("a.r", "b.r")).first()[0] > 0.9


def explicit_fit(net, x, xb, target, kind, draws, seed):
    """The same regressions with every perturbed input written out."""
    from chronoscope.operators.network import softmax
    d = len(x)
    if kind == "kernelshap":
        masks, weights = SG.coalitions(d, draws, seed)
        v = [softmax(net.logits(z[None]))[0, target] for z in (xb, x)]
        y = softmax(net.logits(xb + masks * (x - xb)))[:, target]
        return SG.kernel_values(masks, weights, y, *v)
    masks = (np.random.default_rng(seed).random((draws, d)) < 0.5).astype(float)
    inputs = xb + masks * (x - xb)
    y = softmax(net.logits(inputs))[:, target]
    cos = (inputs @ x) / (np.linalg.norm(inputs, axis=1) * np.linalg.norm(x) + 1e-12)
    w = np.exp(-((1 - cos) ** 2) / SG.LIME_KERNEL_WIDTH ** 2)
    a = np.hstack([np.ones((draws, 1)), masks])
    return np.linalg.solve((a * w[:, None]).T @ a + SG.LIME_RIDGE * np.eye(d + 1), (a * w[:, None]).T @ y)[1:]


def test_fits_in_blocks_equal_the_explicit_regressions(monkeypatch):
    from chronoscope.operators.network import Network
    r = np.random.default_rng(9)
    for sizes in ((12, 3), (30, 6, 4), (1, 2)):
        layers = tuple((r.normal(size=(o, i)), r.normal(size=o)) for i, o in zip(sizes, sizes[1:]))
        net = Network(np.zeros(sizes[0], int), np.arange(sizes[0]), layers, "tanh")
        x, xb = r.normal(size=(2, sizes[0]))
        for kind in ("kernelshap", "lime"):
            if kind == "kernelshap" and sizes[0] == 1:
                continue
            want = explicit_fit(net, x, xb, 1, kind, 1024, 5)
            for block in (200, 1 << 22):
                monkeypatch.setattr(SG, "BLOCK_CELLS", block)
                SG._SHARED.clear()
                assert np.allclose(SG.fitted_values(net, x, xb, 1, kind, 1024, 5), want, atol=1e-9)
