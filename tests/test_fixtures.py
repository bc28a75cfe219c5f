"""Micro fixtures with hand-checked answers (FIXTURES.md section 4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscope.functions.integrate import simpson, trapezoid
from chronoscope.functions.rand import uniform_int
from chronoscope.operators import corrupt as C
from chronoscope.operators import prepare as P

# relevance of one sample, T = 6, F = 2 (rows = t): (f0, f1)
REL = [(0.1, 0.8), (0.5, -0.3), (0.6, 0.2), (-0.2, 0.0), (0.9, 0.4), (0.3, 0.7)]


def _rel_df(spark):
    rows = [("m", 1, f, t, 0.0, REL[t][f]) for t in range(6) for f in range(2)]
    return spark.createDataFrame(rows, "method string, noun_id long, feature long, t long, x double, r double")


def test_simpson_rule(spark):
    curves = {1: [1], 2: [1, 2], 3: [1, 2, 4], 4: [1, 2, 4, 8], 5: [1, 2, 4, 8, 16]}
    rows = [(n, i, float(v)) for n, ys in curves.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "n int, i int, y double")
    got = {r["n"]: r["simpson"] for r in simpson(df, ["n"], "i", "y").collect()}
    want = {1: 0.0, 2: 1.5, 3: 13 / 3, 4: 10.25, 5: 21.666666666666668}
    for n, v in want.items():
        assert got[n] == pytest.approx(v, abs=1e-9)
    # with x spacing 1 the non-uniform form gives the same numbers
    dfx = df.withColumn("x", F.col("i").cast("double"))
    gotx = {r["n"]: r["simpson"] for r in simpson(dfx, ["n"], "i", "y", "x").collect()}
    for n, v in want.items():
        assert gotx[n] == pytest.approx(v, abs=1e-9)


def test_trapezoid(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 2.0), (0, 3.0, 2.0)], "g int, x double, y double")
    assert trapezoid(df, ["g"], "x", "y", "x").collect()[0]["trapz"] == pytest.approx(1.0 + 4.0)


def test_seeded_draws(spark):
    df = spark.range(3).select(uniform_int(42, "id").alias("u"))
    assert [r["u"] for r in df.orderBy("u").collect()] == sorted([3092353741, 2791757499, 348818693])


def test_threshold_kept_runs_tic(spark):
    rel = C.prepare_rel(_rel_df(spark))
    stats = C.relevance_stats(rel)
    fm = C.feature_metrics(C.kept_cells(rel, stats), rel)
    sm = {r["g"]: r for r in C.sample_metrics(fm, stats).collect()}
    thr = stats.collect()[0]["thr"]
    # top k=.25 is g=2, bottom k=.25 is g=13, top k=1 is g=10
    assert thr[2] == pytest.approx(0.675)
    assert thr[13] == pytest.approx(0.225)
    assert thr[10] == pytest.approx(0.0)
    fmr = {(r["g"], r["feature"]): r for r in fm.collect()}
    assert fmr[(2, 0)]["n_kept"] == 1 and fmr[(2, 0)]["tic"] == pytest.approx(0.0)
    assert fmr[(2, 1)]["n_kept"] == 2 and fmr[(2, 1)]["tic"] == pytest.approx(0.576923, abs=1e-6)
    assert fmr[(13, 1)]["tic"] == pytest.approx(0.076923, abs=1e-6)
    for g, ratio, block in [(2, 0.25, 1), (13, 0.25, 2), (10, 10 / 12, 2)]:
        assert sm[g]["mean_ratio_pts_removed"] == pytest.approx(ratio)
        assert sm[g]["drop_prob"] == pytest.approx(ratio)
        assert sm[g]["block_size"] == block


def test_block_dilation():
    """Seed mask 0 0 1 0 0 0 0 1 0: b=3 -> 0 1 1 1 0 0 1 1 1; b=4 -> 0 1 1 1 1 0 1 1 1, plus an extra column."""
    from chronoscope.operators.blocks import dilated
    seeds = np.array([[0, 0, 1, 0, 0, 0, 0, 1, 0]], bool)
    for b, want, count in [(3, [0, 1, 1, 1, 0, 0, 1, 1, 1], 6), (4, [0, 1, 1, 1, 1, 0, 1, 1, 1], 8), (2, [0, 0, 1, 1, 0, 0, 0, 1, 1], 4), (1, [0, 0, 1, 0, 0, 0, 0, 1, 0], 2)]:
        masked, n = dilated(seeds, b)
        # step t is masked if a seed lies in [t - b // 2, t + b - 1 - b // 2]
        brute = [any(seeds[0, s] for s in range(max(0, t - b // 2), min(9, t + b - b // 2))) for t in range(9)]
        assert masked[0].tolist() == brute and n[0] == count
        if b > 2:
            assert masked[0].astype(int).tolist() == want


def test_resize(spark):
    cells = spark.createDataFrame([(1, 0, t, float(t)) for t in range(7)], "noun_id long, feature long, t long, x double")
    for crop, want in [("end", [0, 1, 2, 3]), ("start", [3, 4, 5, 6]), ("both", [2, 3, 4, 5])]:
        got = [r["x"] for r in P.resize(cells, 4, crop).orderBy("t").collect()]
        assert got == [float(v) for v in want]


def test_split_sizes(spark):
    ids = spark.range(10).withColumnRenamed("id", "noun_id")
    sizes = {r["split"]: r["count"] for r in P.assign_split(ids).groupBy("split").count().collect()}
    assert sizes == {"train": 7, "val": 2, "test": 1}
    assert math.isclose(sum(sizes.values()), 10)


def test_draws_are_those_of_the_column_functions(spark):
    from chronoscope.functions.rand import md5_key, normal, uniform_chunk
    from chronoscope.operators.blocks import Draws, normals
    names = [f"{f}|{t}" for f in (0, 1) for t in range(5)]
    rows = spark.createDataFrame([(3, 77, f, t) for f in (0, 1) for t in range(5)], "g long, noun_id long, feature long, t long")
    want = [r[0] for r in rows.orderBy("feature", "t").select(normal(42, F.lit("random"), "g", "noun_id", "feature", "t")).collect()]
    assert np.allclose(normals(42, "random", 3, 77, names), want, atol=1e-14)
    draws = Draws(42, 3, 77, names)
    for a in (0, 3, 9, 25):
        key = md5_key(42, F.lit("rb"), "g", "noun_id", "feature", "t", F.lit(a // 4))
        want = [r[0] for r in rows.orderBy("feature", "t").select(uniform_chunk(key, F.lit(a % 4))).collect()]
        assert draws.four(a // 4)[a % 4].tolist() == want


def test_wide_matrix_round_trip(spark, tmp_path):
    """A7 / A8 on a three-sample slice of the embeddings signals (a small export, as the layout intends)."""
    from chronoscope.sources.signals import cells_from_embeddings
    from chronoscope.sources.text_formats import read_wide_matrix, write_wide_matrix
    from paths import SF001
    cells = cells_from_embeddings(spark, SF001)
    ids = [r["noun_id"] for r in cells.select("noun_id").distinct().orderBy("noun_id").limit(3).collect()]
    part = cells.where(F.col("noun_id").isin(ids))
    write_wide_matrix(part.withColumnRenamed("x", "r"), str(tmp_path / "wide"), "r")
    back = read_wide_matrix(spark, str(tmp_path / "wide"))
    a = {(int(r["noun_id"]), r["feature"], r["t"]): r["x"] for r in back.collect()}
    b = {(r["noun_id"], r["feature"], r["t"]): r["x"] for r in part.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in b)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from chronoscope.functions.ranking import exact_quantiles
    vals = [float((i * 37) % 101) / 7.0 for i in range(1000)] + [3.0] * 50  # ties included
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    qs = [0.0, 0.05, 0.5, 0.85, 0.95, 1.0]
    want = np.quantile(np.array(vals), qs)
    import chronoscope.functions.ranking as R
    assert exact_quantiles(df, "v", qs) == pytest.approx(list(want), abs=1e-12)
    ranges = R.RANGES
    try:
        for R.RANGES in (2, 7):  # many values in a range
            assert exact_quantiles(df, "v", qs) == pytest.approx(list(want), abs=1e-12)
    finally:
        R.RANGES = ranges
    assert exact_quantiles(df.limit(0), "v", qs) == [None] * len(qs)


def test_masks_do_not_depend_on_the_scale_of_relevance(spark):
    """Tiny relevance keeps its signs and its order; NaN is in no mask."""
    from chronoscope.operators import corrupt as C
    for scale in (1.0, 4e-10, 1e-30):
        rows = [(1, 0, t, 0.0, scale * (1 + t) * (-1 if t % 2 else 1)) for t in range(64)] + [(2, 0, t, 0.0, float("nan") if t < 10 else scale) for t in range(64)]
        rel = C.prepare_rel(spark.createDataFrame(rows, "noun_id long, feature long, t long, x double, r double"))
        stats = C.relevance_stats(rel)
        kept = C.kept_cells(rel, stats)
        n = {(r["noun_id"], r["g"]): r["count"] for r in kept.groupBy("noun_id", "g").count().collect()}
        assert {r["noun_id"]: r["n_nonneg"] for r in stats.collect()} == {1: 32, 2: 54}
        assert n[1, 0] == 2 and n[1, 10] == 32 and n[1, 11] == 2  # top .05, top 1.0, bottom .05 of 32 values
        assert all(n[2, g] == 54 for g in range(22))  # all tied


def test_unseen_label_is_an_error(spark):
    from chronoscope.operators import prepare as P
    enc = P.fit_encoder(spark.createDataFrame([(1, "a"), (2, "b")], "noun_id long, target string"))
    new = spark.createDataFrame([(3, "a"), (4, "c")], "noun_id long, target string")
    with pytest.raises(Exception, match="not seen"):
        P.encode_targets(new, enc).collect()
    assert [r["noun_id"] for r in P.encode_targets(new, enc, unseen="drop").collect()] == [3]


def test_block_shuffle_is_a_shared_permutation(spark):
    """Against applying the block permutations to the values one after the other."""
    from chronoscope.operators import augment as AG
    cells = spark.createDataFrame([(n, f, t, float(100 * n + t)) for n in (1, 2) for f in (0, 1) for t in range(60)], "noun_id long, feature long, t long, x double")
    got = {}
    for r in AG.block_shuffle(cells, 0.4, 7).collect():
        got.setdefault((r["noun_id"], r["feature"]), {})[r["t"]] = r["x"]
    gamma = 0.4 / 7 * (60 / 54) * 1.1
    for (n, f), values in got.items():
        x = [float(100 * n + t) for t in range(60)]
        for t in range(60):
            if AG._draw(AG.SEED, "shuffle_block", f, t) < gamma:
                part = x[t:t + 7]
                keys = [AG._draw(AG.SEED, "shuffle_perm", f, t, j) for j in range(len(part))]
                x[t:t + 7] = [v for _, v in sorted(zip(keys, part))]
        assert [values[t] for t in range(60)] == x and x != sorted(x)


def test_no_rounding_of_relevance(spark):
    """One cell of 1, five of .5 and four that are barely negative: the four are in no mask."""
    values = [1.0] + [-4e-13] * 4 + [0.5] * 5
    rel = C.prepare_rel(spark.createDataFrame([(1, 0, t, 0.0, r) for t, r in enumerate(values)], "noun_id long, feature long, t long, x double, r double"))
    stats = C.relevance_stats(rel)
    n = {r["g"]: r["count"] for r in C.kept_cells(rel, stats).groupBy("g").count().collect()}
    assert stats.first()["n_nonneg"] == 6 and n[10] == 6 and n[0] == 1


@pytest.mark.parametrize("sorted_rows", [5, 40, 1 << 18])
def test_order_statistics_of_a_large_group(spark, sorted_rows):
    """One group with most of the values (many of them equal, some far away), next to small ones."""
    from chronoscope.functions.ranking import grouped_order_stats
    rng = np.random.default_rng(3)
    groups = {0: np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [1e300, -1e300, 1e-300]]), 1: rng.normal(size=7), 2: np.full(300, 2.0), 3: np.array([5.0]),
              4: np.array([0.0, -0.0] * 30 + [1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None), (5, None)]
    want = {g: sorted({int(p * (len(v) - 1)) for p in (0, 0.1, 0.5, 0.51, 0.9, 1)}) for g, v in groups.items()}
    asked = spark.createDataFrame([(g, len(groups[g]), w) for g, w in want.items()], "g long, n long, want array<long>")
    got = grouped_order_stats(spark.createDataFrame(rows, "g long, v double").repartition(4), ["g"], "v", asked, sorted_rows).collect()
    assert {r["g"]: r["at"] for r in got} == {g: {p: float(np.sort(groups[g])[p]) for p in w} for g, w in want.items()}


def test_thresholds_as_percentiles(spark):
    """Against Spark's own percentile, with buffers of all sizes."""
    rng = np.random.default_rng(4)
    rows = [(i, 0, t, 0.0, float(rng.normal())) for i, n in ((1, 900), (2, 64), (3, 1)) for t in range(n)] + [(3, 0, 5, 0.0, 1.0), (4, 0, 0, 0.0, -1.0)]
    rel = C.prepare_rel(spark.createDataFrame(rows, "noun_id long, feature long, t long, x double, r double"))
    nonneg = F.when(F.col("r") >= 0, F.col("r"))
    want = {r["noun_id"]: r for r in rel.groupBy("noun_id").agg(F.percentile(nonneg, F.array(*[F.lit(q) for _, _, _, q in C.grid()])).alias("thr"), F.percentile("r", F.lit(0.5)).alias("median_Rx"), F.count(nonneg).alias("n")).where("n > 0").collect()}
    for sorted_rows in (10, 1 << 18):
        got = {r["noun_id"]: r for r in C.relevance_stats(rel, sorted_rows).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i]["thr"] == pytest.approx(want[i]["thr"]) and got[i]["median_Rx"] == pytest.approx(want[i]["median_Rx"])


def test_a_lost_sample_is_an_error(spark):
    from paths import SF001
    from chronoscope.plans import pipeline as PL
    pr = PL.prepared(spark, SF001, "emb")
    state = PL._state(pr)[0]
    rel = PL.relevance(pr, "saliency")
    ev = PL.expected_value(pr, "saliency").withColumn("method", F.lit("-"))
    one = state.select(F.min("noun_id")).first()[0]
    with pytest.raises(ValueError, match="rows of metrics"):
        C.corruption_results(rel, pr.network, state.where(F.col("noun_id") != one), pr.labelled, pr.encoder, ev)
    n = rel.select("noun_id").distinct().count()
    assert C.corruption_results(rel, pr.network, state, pr.labelled, pr.encoder, ev).count() == 22 * n
