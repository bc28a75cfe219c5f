"""Attribution of the predicted class of a linear-softmax model, as Spark jobs.

Model: z_c = sum_j w[c,j] x_j + b_c, p = softmax(z); target c* = predicted class.
Gradient: d p_c / d x_j = p_c (w[c,j] - sum_k p_k w[k,j]).

Layout. Per cell we attach `w_arr` (the weights of all C classes for that (feature, t);
broadcast, bounded by C*F*T) and per sample the coefficient arrays of that sample
(bounded by C), joined on noun_id only: both sides are hash-partitioned on noun_id, so
the join adds no exchange and the relevance is one row per cell.

Methods (each cell is its own player; baselines as in the reference's defaults):
  saliency     |grad|
  ig           (x - b) * integral_0^1 grad(b + a (x - b)) da, 50 Gauss-Legendre nodes, random baseline
  deeplift     rescale rule on mean-centred logits: (dp_c / dz~_c) * (w[c,j] - mean_k w[k,j]) (x_j - b_j)
  deepliftshap deeplift averaged over <= 50 sample baselines
  gradshap     mean over 5 draws (baseline from the sample set, a ~ U) of grad(b + a(x-b)) * (x - b)
  shapleyvalue 25 md5-ordered permutations of cells, marginal change of p_c, random baseline
  lrp          epsilon rule on the linear layer, output relevance p_c
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast
from chronoscope.functions.rand import normal, sort_key60, uniform  # noqa: F401 (re-exported)
from chronoscope.functions.ranking import spread
from chronoscope.operators.model import softmax

SEED = 42
N_BASELINE_SAMPLES = 50
IG_STEPS = 50
GRADSHAP_SAMPLES = 5
SHAPLEY_PERMUTATIONS = 25
LRP_EPS = 1e-9
METHODS = ("integrated_gradients", "deeplift", "deepliftshap", "gradshap", "shapleyvalue", "saliency", "lrp")


def gauss_legendre(n: int = IG_STEPS) -> tuple[list[float], list[float]]:
    """Nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return [float(v) for v in (x + 1.0) / 2.0], [float(v) for v in w / 2.0]


# ---- shared pieces ----------------------------------------------------------------------------

def weight_arrays(W: DataFrame) -> DataFrame:
    """(feature, t, w_arr): weights of all classes ordered by class_idx (bounded: C per row)."""
    return W.groupBy("feature", "t").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "w"))), lambda s: s["w"]).alias("w_arr"))


def per_sample_arrays(p: DataFrame, keys=("noun_id",), cols=("z", "p")) -> DataFrame:
    """(keys..., z_arr, p_arr) ordered by class_idx."""
    st = F.sort_array(F.collect_list(F.struct("class_idx", *cols)))

    def field(c):
        return lambda s: s[c]
    return p.groupBy(*keys).agg(*[F.transform(st, field(c)).alias(f"{c}_arr") for c in cols])


def arr_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def arr_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def with_softmax(df: DataFrame, z: Column, out: str) -> DataFrame:
    """Adds `out` = softmax(z) through staged columns: each intermediate array is computed once
    per row (a nested expression would re-evaluate the max inside every lambda call)."""
    t = f"_{out}"
    return (df.withColumn(f"{t}_z", z)
            .withColumn(f"{t}_m", F.array_max(f"{t}_z"))
            .withColumn(f"{t}_e", F.transform(f"{t}_z", lambda v: F.exp(v - F.col(f"{t}_m"))))
            .withColumn(f"{t}_s", F.aggregate(f"{t}_e", F.lit(0.0), lambda acc, v: acc + v))
            .withColumn(out, F.transform(f"{t}_e", lambda v: v / F.col(f"{t}_s")))
            .drop(f"{t}_z", f"{t}_m", f"{t}_e", f"{t}_s"))


def at(a: Column, idx: Column) -> Column:
    """0-based element access."""
    return F.element_at(a, (idx + 1).cast("int"))


def sample_state(p1: DataFrame, score1: DataFrame) -> DataFrame:
    """(noun_id, pred, s1, z_arr, p_arr)."""
    return per_sample_arrays(p1).join(score1, "noun_id")


# ---- baselines (J5-J8) ---------------------------------------------------------------------

def baseline_random(W: DataFrame, seed: int = SEED) -> DataFrame:
    """One N(0,1) draw per (feature, t), shared by all samples."""
    return W.select("feature", "t").distinct().select("feature", "t", normal(seed, F.lit("baseline"), "feature", "t").alias("xb"))


def baseline_zeros(W: DataFrame) -> DataFrame:
    return W.select("feature", "t").distinct().select("feature", "t", F.lit(0.0).alias("xb"))


def baseline_mean(cells: DataFrame) -> DataFrame:
    """Mean over samples per (feature, t)."""
    return cells.groupBy("feature", "t").agg(F.avg("x").alias("xb"))


def baseline_ids(cells: DataFrame, n: int = N_BASELINE_SAMPLES, seed: int = SEED) -> DataFrame:
    """(bid, noun_id): the first n samples in md5 order. An ordered limit keeps n rows per task; only
    those are ranked."""
    ids = cells.select("noun_id").distinct().withColumn("_h", sort_key60(seed, F.lit("baseline"), "noun_id"))
    top = ids.orderBy("_h", "noun_id").limit(n)
    return top.select((F.row_number().over(Window.orderBy("_h", "noun_id")) - 1).cast("bigint").alias("bid"), "noun_id")


def baseline_sample(cells: DataFrame, n: int = N_BASELINE_SAMPLES, seed: int = SEED) -> DataFrame:
    """(bid, feature, t, xb): the cells of the first n samples in md5 order."""
    return cells.join(F.broadcast(baseline_ids(cells, n, seed)), "noun_id").select("bid", "feature", "t", F.col("x").alias("xb"))  # <= n rows


def baseline_logits(base: DataFrame, W: DataFrame, B: DataFrame, keys=()) -> DataFrame:
    """(keys..., class_idx, z) of baseline signals."""
    z = base.join(bounded_broadcast(W), ["feature", "t"]).groupBy(*keys, "class_idx").agg(F.sum(F.col("xb") * F.col("w")).alias("_z"))
    return z.join(bounded_broadcast(B), "class_idx").select(*keys, "class_idx", (F.col("_z") + F.col("b")).alias("z"))


def single_baseline_state(base: DataFrame, W: DataFrame, B: DataFrame):
    """(zb_arr, pb_arr) of one baseline as scalar subquery columns (bounded by C)."""
    zb = softmax(baseline_logits(base, W, B).withColumn("_one", F.lit(1)), keys=("_one",))
    arrs = per_sample_arrays(zb, keys=("_one",))
    return arrs.select("z_arr").scalar(), arrs.select("p_arr").scalar()


# ---- methods -----------------------------------------------------------------------------------

def _cells_w(cells: DataFrame, W: DataFrame) -> DataFrame:
    return cells.join(bounded_broadcast(weight_arrays(W)), ["feature", "t"])


def saliency(cells, W, B, st) -> DataFrame:
    j = _cells_w(cells, W).join(st, "noun_id")
    g = F.col("s1") * (at(F.col("w_arr"), F.col("pred")) - arr_dot(F.col("p_arr"), F.col("w_arr")))
    return j.select("noun_id", "feature", "t", "x", F.abs(g).alias("r"))


def integrated_gradients(cells, W, B, st, base, p1=None) -> DataFrame:
    """IG with the 50-node Gauss-Legendre rule. For a linear model z(b + a(x - b)) = zb + a (zx - zb),
    so the path integral needs per sample only A = sum_s g_s p_c(a_s) and B_k = sum_s g_s p_c(a_s) p_k(a_s):
    rows (sample, node, class) with a window softmax, then r_j = (x_j - b_j)(w[c,j] A - sum_k B_k w[k,j])."""
    zb = baseline_logits(base, W, B).select("class_idx", F.col("z").alias("zb"))
    nodes, weights = gauss_legendre()
    node = F.explode(F.arrays_zip(F.array(*[F.lit(v) for v in nodes]).alias("a"),
                                  F.array(*[F.lit(v) for v in weights]).alias("g")))
    zx = spread(st, "noun_id").select("noun_id", "pred", F.posexplode("z_arr").alias("class_idx", "z"))
    rows = zx.join(bounded_broadcast(zb), "class_idx").select("noun_id", "pred", "class_idx", "z", "zb", node.alias("nd"))
    rows = rows.select("noun_id", "pred", "class_idx", F.col("nd.a").alias("a"), F.col("nd.g").alias("g"),
                       (F.col("zb") + F.col("nd.a") * (F.col("z") - F.col("zb"))).alias("za"))
    pa = softmax(rows, keys=("noun_id", "a"), zcol="za", out="pa")
    wn = Window.partitionBy("noun_id", "a")
    pa = pa.withColumn("pc", F.max(F.when(F.col("class_idx") == F.col("pred"), F.col("pa"))).over(wn))
    coef = pa.groupBy("noun_id", "class_idx").agg(F.sum(F.col("g") * F.col("pc") * F.col("pa")).alias("bk"),
                                                  F.sum(F.col("g") * F.col("pc")).alias("a"))
    coef = coef.groupBy("noun_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "bk"))), lambda s: s["bk"]).alias("b_arr"),
        F.first("a").alias("a_coef"))
    j = _cells_w(cells, W).join(bounded_broadcast(base), ["feature", "t"]).join(st.select("noun_id", "pred"), "noun_id").join(coef, "noun_id")
    r = (F.col("x") - F.col("xb")) * (at(F.col("w_arr"), F.col("pred")) * F.col("a_coef") - arr_dot(F.col("b_arr"), F.col("w_arr")))
    return j.select("noun_id", "feature", "t", "x", r.alias("r"))


def _rescale_multiplier(z_arr: Column, p_arr: Column, zb_arr: Column, pb_arr: Column, pred: Column) -> Column:
    dzt = (at(z_arr, pred) - arr_mean(z_arr)) - (at(zb_arr, pred) - arr_mean(zb_arr))
    dp = at(p_arr, pred) - at(pb_arr, pred)
    return F.when(dzt != 0, dp / dzt).otherwise(F.lit(0.0))


def deeplift(cells, W, B, st, base) -> DataFrame:
    zb, pb = single_baseline_state(base, W, B)
    m = st.withColumn("_zb", zb).withColumn("_pb", pb).select(
        "noun_id", "pred", _rescale_multiplier(F.col("z_arr"), F.col("p_arr"), F.col("_zb"), F.col("_pb"), F.col("pred")).alias("m"))
    j = _cells_w(cells, W).join(bounded_broadcast(base), ["feature", "t"]).join(m, "noun_id")
    wt = at(F.col("w_arr"), F.col("pred")) - arr_mean(F.col("w_arr"))
    return j.select("noun_id", "feature", "t", "x", (F.col("m") * wt * (F.col("x") - F.col("xb"))).alias("r"))


def _baseline_set_state(bases: DataFrame, W: DataFrame, B: DataFrame) -> DataFrame:
    """(bid, zb_arr, pb_arr) for a bounded set of baselines (<= N_BASELINE_SAMPLES rows)."""
    zb = softmax(baseline_logits(bases, W, B, keys=("bid",)), keys=("bid",))
    return per_sample_arrays(zb, keys=("bid",)).withColumnRenamed("z_arr", "zb_arr").withColumnRenamed("p_arr", "pb_arr")


def _baseline_set_array(bases: DataFrame, W: DataFrame, B: DataFrame) -> Column:
    """The whole (bounded) baseline set as one array<struct<bid, zb_arr, pb_arr>> scalar."""
    bst = _baseline_set_state(bases, W, B)
    return bst.select(F.sort_array(F.collect_list(F.struct("bid", "zb_arr", "pb_arr")))).scalar()


def _baseline_arrays(bases: DataFrame) -> DataFrame:
    """(feature, t, xbs): values of all baselines ordered by bid (bounded: <= 50 per row)."""
    return bases.groupBy("feature", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("bid", "xb"))), lambda s: s["xb"]).alias("xbs"))


def _model_and_baselines(W: DataFrame, bases: DataFrame) -> DataFrame:
    return weight_arrays(W).join(_baseline_arrays(bases), ["feature", "t"])


def deepliftshap(cells, W, B, st, bases) -> DataFrame:
    """Mean over the baselines b of m_b w (x - xb_b): x sum(m) - sum(m_b xb_b), by arrays in the cell's
    row; no row per baseline."""
    bset = _baseline_set_array(bases, W, B)
    m = st.withColumn("_bs", bset).select("noun_id", "pred", F.transform(
        "_bs", lambda b: _rescale_multiplier(F.col("z_arr"), F.col("p_arr"), b["zb_arr"], b["pb_arr"], F.col("pred"))).alias("ms"))
    j = cells.join(m, "noun_id").join(bounded_broadcast(_model_and_baselines(W, bases)), ["feature", "t"])
    s = F.aggregate(F.zip_with("ms", "xbs", lambda mb, xb: mb * (F.col("x") - xb)), F.lit(0.0), lambda acc, v: acc + v)
    wt = at(F.col("w_arr"), F.col("pred")) - arr_mean(F.col("w_arr"))
    return j.select("noun_id", "feature", "t", "x", (wt * s / F.size("xbs")).alias("r"))


def gradshap(cells, W, B, st, bases, n_samples: int = GRADSHAP_SAMPLES, seed: int = SEED) -> DataFrame:
    """Mean over the draws s of gradient(point of s) (x - xb of s). A sample's draws are an array of
    n_samples in its row; no row per draw and cell."""
    bst = bounded_broadcast(_baseline_set_state(bases, W, B))  # <= 50 rows
    nb = bases.select(F.count_distinct("bid")).scalar()
    draws = st.select("noun_id", "pred", "z_arr", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("s"))
    draws = draws.withColumn("bid", F.floor(uniform(seed, F.lit("gs_b"), "noun_id", "s") * nb).cast("bigint")) \
                 .withColumn("alpha", uniform(seed, F.lit("gs_a"), "noun_id", "s"))
    d = draws.join(bst, "bid")
    za = F.zip_with(F.col("zb_arr"), F.col("z_arr"), lambda b, x: b + F.col("alpha") * (x - b))
    d = with_softmax(d, za, "_pa").select("noun_id", "pred", F.struct("s", "bid", F.col("_pa").alias("pa"), at(F.col("_pa"), F.col("pred")).alias("pc")).alias("d"))
    d = d.groupBy("noun_id", "pred").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    j = cells.join(d, "noun_id").join(bounded_broadcast(_model_and_baselines(W, bases)), ["feature", "t"])

    def term(s):
        g = s["pc"] * (at(F.col("w_arr"), F.col("pred")) - arr_dot(s["pa"], F.col("w_arr")))
        return g * (F.col("x") - at(F.col("xbs"), s["bid"]))

    total = F.aggregate(F.transform("ds", term), F.lit(0.0), lambda acc, v: acc + v)
    return j.select("noun_id", "feature", "t", "x", (total / n_samples).alias("r"))


def shapley_sampling(cells, W, B, st, base, n_perm: int = SHAPLEY_PERMUTATIONS, seed: int = SEED) -> DataFrame:
    zb, pb = single_baseline_state(base, W, B)
    c = spread(cells.join(bounded_broadcast(base), ["feature", "t"]).join(st.select("noun_id", "pred"), "noun_id"), "noun_id")
    c = c.select("noun_id", "feature", "t", "x", "xb", "pred", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    c = c.withColumn("_o", sort_key60(seed, F.lit("sv"), "noun_id", "perm", "feature", "t"))
    cw = c.join(bounded_broadcast(W), ["feature", "t"]).withColumn("_d", F.col("w") * (F.col("x") - F.col("xb")))
    wrun = Window.partitionBy("noun_id", "perm", "class_idx").orderBy("_o", "feature", "t").rowsBetween(Window.unboundedPreceding, 0)
    zrun = cw.withColumn("_zb", zb).select(
        "noun_id", "perm", "feature", "t", "x", "pred", "class_idx", "_o",
        (at(F.col("_zb"), F.col("class_idx")) + F.sum("_d").over(wrun)).alias("z"))
    # the C logits of one step gathered by a hash aggregate on the same noun_id partitioning (no sort),
    # softmax on that small array, keep the predicted class's probability
    steps = zrun.groupBy("noun_id", "perm", "feature", "t").agg(
        F.first("x").alias("x"), F.first("pred").alias("pred"), F.first("_o").alias("_o"),
        F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "z"))), lambda s: s["z"]).alias("_z"))
    steps = with_softmax(steps, F.col("_z"), "_p").withColumn("p", at(F.col("_p"), F.col("pred")))
    wlag = Window.partitionBy("noun_id", "perm").orderBy("_o", "feature", "t")
    prev = F.lag("p", 1).over(wlag)
    first_prev = at(F.col("_pb"), F.col("pred"))  # nothing added yet: the baseline's own p_c
    marg = steps.withColumn("_pb", pb).select("noun_id", "perm", "feature", "t", "x",
                                              (F.col("p") - F.coalesce(prev, first_prev)).alias("dp"))
    return marg.groupBy("noun_id", "feature", "t").agg(F.first("x").alias("x"), (F.sum("dp") / n_perm).alias("r"))


def lrp(cells, W, B, st) -> DataFrame:
    j = _cells_w(cells, W).join(st, "noun_id")
    zc = at(F.col("z_arr"), F.col("pred"))
    den = zc + F.lit(LRP_EPS) * F.when(zc >= 0, 1.0).otherwise(-1.0)
    return j.select("noun_id", "feature", "t", "x",
                    (F.col("x") * at(F.col("w_arr"), F.col("pred")) / den * F.col("s1")).alias("r"))


def expected_value_single(base, W, B, st) -> DataFrame:
    """(noun_id, expected_value): model output on the baseline at the predicted class."""
    _, pb = single_baseline_state(base, W, B)
    return st.withColumn("_pb", pb).select("noun_id", at(F.col("_pb"), F.col("pred")).alias("expected_value"))


def expected_value_set(bases, W, B, st) -> DataFrame:
    """Mean prediction over the baseline set, at the predicted class."""
    zb = softmax(baseline_logits(bases, W, B, keys=("bid",)), keys=("bid",))
    mean_p = zb.groupBy("class_idx").agg(F.avg("p").alias("p"))
    arr = mean_p.select(F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "p"))), lambda s: s["p"])).scalar()
    return st.withColumn("_pb", arr).select("noun_id", at(F.col("_pb"), F.col("pred")).alias("expected_value"))
