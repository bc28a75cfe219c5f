
import pytest
from pyspark.sql import functions as F

from paths import SF001
from chronoscope.plans.pipeline import expected_value, prepared, relevance, sweep_results


def test_scaler_standardises_train(spark):
    pr = prepared(spark, SF001, "evt")
    std = pr.std_cells.join(pr.train_ids, "noun_id", "left_semi")
    for r in std.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect():
        assert r["m"] == pytest.approx(0.0, abs=1e-9)
        assert r["s"] == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("method", ["deeplift", "shapleyvalue", "integrated_gradients"])
def test_completeness(spark, method):
    """sum_j r_j = p_c(x) - p_c(baseline): exact for DeepLIFT and Shapley sampling, to the
    quadrature error for IG."""
    pr = prepared(spark, SF001, "emb")
    s = relevance(pr, method).groupBy("noun_id").agg(F.sum("r").alias("sr"))
    d = pr.score1.join(expected_value(pr, method), "noun_id").select("noun_id", (F.col("s1") - F.col("expected_value")).alias("dp"))
    tol = 1e-9 if method != "integrated_gradients" else 1e-6
    for r in s.join(d, "noun_id").collect():
        assert r["sr"] == pytest.approx(r["dp"], abs=tol)


def test_top_and_bottom_k1_keep_the_same_cells(spark):
    res = sweep_results(prepared(spark, SF001, "emb"), ("integrated_gradients",))
    k1 = res.where(F.col("k") == 1.0).groupBy("noun_id").agg(
        F.max(F.when(F.col("mask") == "top", F.col("mean_n_pts_removed"))).alias("a"),
        F.max(F.when(F.col("mask") == "bottom", F.col("mean_n_pts_removed"))).alias("b"))
    assert k1.where(F.col("a") != F.col("b")).count() == 0


def test_ratio_close_to_k(spark):
    res = sweep_results(prepared(spark, SF001, "emb"), ("integrated_gradients",))
    r = res.where(F.col("mask") == "top").groupBy("k").agg(F.avg("mean_ratio_pts_removed").alias("ratio")).collect()
    ratio = {row["k"]: row["ratio"] for row in r}
    assert ratio[0.05] < ratio[0.55] < ratio[1.0]


def test_partitioning_does_not_change_results(spark):
    from chronoscope.operators import attribute as A
    pr = prepared(spark, SF001, "emb")
    st = A.sample_state(pr.p1, pr.score1)
    base = A.baseline_random(pr.W)
    a = A.shapley_sampling(pr.test_cells, pr.W, pr.B, st, base, n_perm=3)
    b = A.shapley_sampling(pr.test_cells.repartition(3), pr.W, pr.B, st.repartition(5), base, n_perm=3)
    da = {(r["noun_id"], r["t"]): r["r"] for r in a.collect()}
    db = {(r["noun_id"], r["t"]): r["r"] for r in b.collect()}
    assert da.keys() == db.keys()
    assert all(abs(da[k] - db[k]) < 1e-12 for k in da)


def test_default_methods_sweep(spark):
    """All six methods, KernelSHAP included: every sample has 22 rows a method, k = 1 removes the same cells from
    either end, and a method's rows do not depend on the others."""
    from chronoscope.plans.pipeline import DEFAULT_METHODS, Prepared
    pr = Prepared(spark, SF001)
    res = sweep_results(pr, DEFAULT_METHODS)
    n = pr.test_ids.count()
    assert {r["method"]: r["count"] for r in res.groupBy("method").count().collect()} == {m: 22 * n for m in DEFAULT_METHODS}
    k1 = res.where("k = 1").groupBy("method", "noun_id").agg(F.count_distinct("mean_n_pts_removed").alias("n"), F.count("metric_normalised").alias("m"))
    assert k1.where("n <> 1 or m <> 0").count() == 0
    assert res.where("abs(delta_score1 - (score1 - score2)) > 1e-12 or metric_normalised not between 0 and 1").count() == 0
    alone = sweep_results(Prepared(spark, SF001), ("deeplift",))
    want = {(r.noun_id, r["mask"], r.k): (r.score2, r.score3) for r in alone.collect()}
    got = {(r.noun_id, r["mask"], r.k): (r.score2, r.score3) for r in res.where("method = 'deeplift'").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_corrupted_scores_of_a_network_by_brute_force(spark):
    """Masks and scores of a perceptron's samples, cell by cell and attempt by attempt."""
    import hashlib
    import math

    import numpy as np

    from chronoscope.operators import corrupt as C
    from chronoscope.operators.network import softmax
    from chronoscope.plans.pipeline import _state

    pr = prepared(spark, SF001, "emb", "perceptron")
    net, pred = pr.network, {r.noun_id: r.pred for r in _state(pr)[0].collect()}
    cells = {}
    for r in relevance(pr, "saliency").collect():
        cells.setdefault(r.noun_id, {})[r.t] = (r.x, r.r)
    res = sweep_results(pr, ("saliency",)).collect()

    def words(*keys):
        h = hashlib.md5("|".join(map(str, (42, *keys))).encode()).hexdigest()
        return [int(h[8 * i:8 * i + 8], 16) / 2 ** 32 for i in range(4)]

    def normal(*keys):
        u = words(*keys)
        return math.sqrt(-2 * math.log(u[0] + 2.0 ** -33)) * math.cos(2 * math.pi * u[1])

    def block(i, g, p, b, T):
        gamma = min(max(p / b * (T / (T - b + 1)) * 1.2, 0), 1)
        best = (math.inf, None)
        for a in range(26):
            seeds = [t for t in range(T) if words("rb", g, i, 0, t, a // 4)[a % 4] < gamma]
            mask = {t for t in range(T) if any(t - b // 2 <= s <= t + b - 1 - b // 2 for s in seeds)}
            extra = b % 2 == 0 and any(s >= T - b / 2 for s in seeds)
            diff = abs(p - (len(mask) + extra) / T)
            if diff <= 0.05:
                return mask
            best = min(best, (diff, mask), key=lambda x: x[0])
        return best[1]

    for i in sorted(cells)[:3]:
        x, r = (np.array([cells[i][t][j] for t in sorted(cells[i])]) for j in (0, 1))
        for row in [row for row in res if row.noun_id == i]:
            g = C.MASKS.index(row["mask"]) * 11 + C.K_VALUES.index(row.k)
            order, k = np.sort(r[r >= 0]), round(row.k * 100)
            last = len(order) - 1
            kept = (r >= order[last - k * last // 100]) if row["mask"] == "top" else ((r >= 0) & (r <= order[k * last // 100]))
            for hit, kind, score in ((np.flatnonzero(kept), "corrupt", row.score2), (sorted(block(i, g, row.drop_prob, row.block_size, len(x))), "random", row.score3)):
                new = x.copy()
                for t in hit:
                    new[t] = normal(kind, g, i, 0, t)
                assert score == pytest.approx(softmax(net.logits(new[None]))[0, pred[i]], abs=1e-9)
