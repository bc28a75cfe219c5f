import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscope.operators import attribute as A
from chronoscope.operators import network as N
from chronoscope.plans import pipeline as PL
from paths import SF001


def net(activation, sizes=(6, 5, 4, 3), seed=0):
    r = np.random.default_rng(seed)
    layers = tuple((r.normal(size=(o, i)), r.normal(size=o)) for i, o in zip(sizes, sizes[1:]))
    return N.Network(np.repeat([0, 1], sizes[0] // 2), np.tile(np.arange(sizes[0] // 2), 2), layers, activation)


@pytest.fixture(scope="module")
def small(spark):
    """Signals of two features and 2 or 3 steps."""
    r = np.random.default_rng(7)
    rows = [(i, f, t, float(r.normal())) for i in range(30) for f in (0, 1) for t in range(3 if i % 4 else 2)]
    return spark.createDataFrame(rows, "noun_id long, feature long, t long, x double").repartition(3)


def matrix(cells):
    rows = {}
    for r in cells.collect():
        rows.setdefault(r.noun_id, np.zeros(6))[r.feature * 3 + r.t] = r.x
    return rows


@pytest.mark.parametrize("activation", ["sigmoid", "tanh", "relu"])
def test_gradient_by_differences(activation):
    n, r = net(activation), np.random.default_rng(1)
    x, target = r.normal(size=(20, 6)), r.integers(0, 3, 20)
    got = n.gradient(x, target)
    for j in range(6):
        step = np.eye(6)[j] * 1e-6
        p = [N.softmax(n.logits(x + s * step))[np.arange(20), target] for s in (1, -1)]
        assert np.allclose(got[:, j], (p[0] - p[1]) / 2e-6, atol=1e-7)


@pytest.mark.parametrize("activation", ["sigmoid", "tanh", "relu"])
def test_rescale_and_relevance_are_complete(activation):
    n, r = net(activation), np.random.default_rng(2)
    x, xb, target = r.normal(size=(20, 6)), r.normal(size=6), r.integers(0, 3, 20)
    p = N.softmax(n.logits(x))[np.arange(20), target] - N.softmax(n.logits(xb[None]))[0, target]
    assert np.allclose((n.rescaled(x, xb, target) * (x - xb)).sum(axis=1), p, atol=1e-9)
    # without biases no relevance is lost on the way down
    bare = N.Network(n.features, n.steps, tuple((w, np.zeros_like(b)) for w, b in n.layers), "relu")
    own = N.softmax(bare.logits(x))[np.arange(20), target]
    alive = np.abs(bare.logits(x)[np.arange(20), target]) > 1e-3
    assert np.allclose(bare.layerwise(x, target, 1e-12).sum(axis=1)[alive], own[alive], atol=1e-6)


@pytest.mark.parametrize("method", ["integrated_gradients", "deeplift", "deepliftshap", "shapleyvalue", "kernelshap"])
@pytest.mark.parametrize("baseline", ["zeros", "random", "mean", "sample"])
def test_completeness_for_every_baseline(spark, small, method, baseline):
    """On signals of unequal length: what a sample lacks is 0, so only baselines of zeros leave its sum whole."""
    n = net("tanh")
    state = N.states(small, n)
    options = {"n_steps": 300} if method == "integrated_gradients" else {}  # the net is steep: 50 nodes give five digits
    rel = N.attribute(method, small, n, baseline, **options)
    got = {r.noun_id: r for r in N.completeness(rel, state, N.expected_values(method, small, n, state, baseline)).collect()}
    assert len(got) == 30
    whole = [r for i, r in got.items() if i % 4 or baseline == "zeros"]
    assert all(r.complete for r in whole), [r for r in whole if not r.complete][:3]


def test_shapley_sampling_is_exact_with_kernelshap_for_few_cells(spark, small):
    n = net("sigmoid")
    exact = {(r.noun_id, r.feature, r.t): r.r for r in N.attribute("kernelshap", small, n, "zeros").collect()}
    drawn = {(r.noun_id, r.feature, r.t): r.r for r in N.attribute("shapleyvalue", small, n, "zeros", n_permutations=400).collect()}
    assert max(abs(exact[k] - drawn[k]) for k in exact) < 0.05
    x = matrix(small)
    assert {i for i, _, _ in exact} == set(x)


def test_options_and_errors(spark, small):
    n = net("relu")
    x = matrix(small)
    plain = {(r.noun_id, r.feature, r.t): (r.x, r.r) for r in N.attribute("integrated_gradients", small, n, "zeros", multiply_by_inputs=False).collect()}
    times = {(r.noun_id, r.feature, r.t): r.r for r in N.attribute("integrated_gradients", small, n, "zeros").collect()}
    assert all(times[k] == pytest.approx(r * v, abs=1e-12) for k, (v, r) in plain.items())
    target = small.select("noun_id", F.lit(1).cast("long").alias("pred")).distinct()
    got = {(r.noun_id, r.feature, r.t): r.r for r in N.attribute("saliency", small, n, target=target).collect()}
    for i, row in x.items():
        want = np.abs(n.gradient(row[None], np.array([1])))[0]
        assert all(got[i, f, t] == pytest.approx(want[f * 3 + t]) for f in (0, 1) for t in range(3) if (i, f, t) in got)
    for bad in (lambda: N.attribute("nonsense", small, n), lambda: N.attribute("lrp", small, n, n_steps=3), lambda: N.attribute("deeplift", small, n, "other")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="does not know"):
        N.attribute("saliency", small.withColumn("t", F.col("t") + 9), n).collect()


def test_changed_cells_move_the_logits(spark, small):
    n, x = net("tanh"), matrix(small)
    changed = small.where("t = 1").select("noun_id", F.lit("m").alias("method"), "feature", "t", F.lit(9.0).alias("x"))
    got = {r.noun_id: r.d_arr for r in N.delta_logits(changed, small, n, ["method", "noun_id"]).collect()}
    for i, row in x.items():
        new = row.copy()
        new[[1, 4]] = 9.0
        assert np.allclose(got[i], n.logits(new[None]) - n.logits(row[None]))


@pytest.mark.parametrize("method", ["saliency", "integrated_gradients", "deeplift", "deepliftshap", "gradshap", "shapleyvalue", "lrp"])
def test_one_layer_equals_the_closed_forms(spark, method):
    pr = PL.prepared(spark, SF001, "emb")
    st, single, several = PL._state(pr)
    base = {"deepliftshap": several, "gradshap": several}.get(method, single)
    args = (pr.test_cells, pr.W, pr.B, st) + (() if method in ("saliency", "lrp") else (base,))
    closed = {"shapleyvalue": A.shapley_sampling}.get(method) or getattr(A, method)
    want = {(r.noun_id, r.feature, r.t): r.r for r in closed(*args).collect()}
    got = {(r.noun_id, r.feature, r.t): r.r for r in N.attribute(method, pr.test_cells, (pr.W, pr.B), base, st).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_fitted_perceptron_scores_as_spark_ml(spark):
    from pyspark.ml.functions import vector_to_array

    from chronoscope.operators import surrogate as S

    pr = PL.prepared(spark, SF001, "emb")
    model, vec = S.fit_ml(pr.std_cells, pr.labelled, pr.train_ids, "mlp")
    n = S.fit_network(pr.std_cells, pr.labelled, pr.train_ids)
    want = {r.noun_id: r.p for r in model.transform(vec).select("noun_id", vector_to_array("probability").alias("p")).collect()}
    got = {r.noun_id: r.p_arr for r in N.states(pr.std_cells, n).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
