"""Top-k / bottom-k corruption sweep (K2, K3) and its per-sample metrics.

Input `rel` = (noun_id, feature, t, x, r): every cell of every evaluated sample with its
relevance. One grid row per (mask, k): k in .05, .15, ..., .95, 1.0 and mask in {top, bottom}
(22 points, g = 0..21). For each sample and grid point:

  threshold  top: quantile(r >= 0, 1 - k); bottom: quantile(r >= 0, k) (linear interpolation),
             pooled over all features; kept = non-negative cells with r >= thr (top) / r <= thr
             (bottom). A value is on the kept side of an interpolated quantile exactly if it is on
             that side of the sorted value next to it, so cells are tested against the value at
             position ceil(q (n - 1)) (top) or floor(q (n - 1)) (bottom), with the position taken
             from k in whole percent: no rounding and no tolerance.
  metrics    mean_n_pts_removed, mean_ratio_pts_removed, mean_tic (Simpson over kept values in
             time order, gaps closed, over Simpson of all non-negative values of the feature),
             run lengths of consecutive kept steps -> block_size, drop_prob.
  scores     kept cells replaced by N(0,1) -> score2; a random block mask with the same
             drop_prob / block_size (best of up to 26 draws) replaced by N(0,1) -> score3
             (`blocks.corrupted_logits`, for any network).

Partitioning: every step is keyed by noun_id (grid points and features are sub-keys), so
the sweep runs on the noun_id partitioning of the test cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.integrate import simpson_agg, simpson_terms
from chronoscope.functions.joins import bounded_broadcast
from chronoscope.functions.ranking import SORTED_ROWS, grouped_order_stats, interpolated, spread
from chronoscope.operators.attribute import at, with_softmax
from chronoscope.operators.blocks import corrupted_logits
from chronoscope.operators.network import Network

SEED = 42
# fixed values: the corruption grid of the reference evaluation
K_VALUES = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.0]
MASKS = ["top", "bottom"]


def grid() -> list[tuple[int, str, float, float]]:
    """(g, mask, k, quantile) for the 22 grid points; quantile = 1 - k (top) or k (bottom)."""
    out = []
    for mi, mask in enumerate(MASKS):
        for ki, k in enumerate(K_VALUES):
            out.append((mi * len(K_VALUES) + ki, mask, k, (1 - k) if mask == "top" else k))
    return out


def _lits(vals) -> Column:
    return F.array(*[F.lit(v) for v in vals])


def prepare_rel(rel: DataFrame) -> DataFrame:
    """(method, noun_id, feature, t, x, r); a missing method column becomes a constant so
    single-method inputs work the same way. NaN relevance becomes null: neither positive nor
    negative, and in no mask. Values are taken as they are."""
    m = F.col("method") if "method" in rel.columns else F.lit("-")
    return rel.select(m.alias("method"), "noun_id", "feature", "t", "x", F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def relevance_stats(rel: DataFrame, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """D6, D7 and the thresholds of all 22 grid points (D5): sums by one aggregate per sample, and the
    sorted values around every quantile by `grouped_order_stats` (no sample's values in one buffer). The
    non-negative values are the last n_nonneg of all sorted ones, so one order serves them and the median.
    `bound` has, per grid point, the sorted value that decides about keeping a cell."""
    from chronoscope.session import materialize
    keys = ["method", "noun_id"]
    nonneg = F.when(F.col("r") >= 0, F.col("r"))
    sums = rel.groupBy(*keys).agg(
        F.min("r").alias("min_Rx"), F.max("r").alias("max_Rx"), F.avg("r").alias("mean_Rx"),
        F.coalesce(F.sum(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("sum_rel_neg"),
        F.coalesce(F.sum(nonneg), F.lit(0.0)).alias("sum_rel_pos"),
        F.count(nonneg).alias("n_nonneg"), F.count("r").alias("n"),
        (F.max("t") + 1).alias("n_steps"), F.count_distinct("feature").alias("n_feat"),
    ).where(F.col("n_nonneg") > 0)  # B8: samples without non-negative relevance are skipped
    below, last = F.col("n") - F.col("n_nonneg"), F.col("n_nonneg") - 1
    thr = [below + F.lit(q) * last for _, _, _, q in grid()]
    bound = []
    for _, mask, k, _ in grid():
        down = F.floor(F.lit(round(k * 100)) * last / 100)
        bound.append(below + (last - down if mask == "top" else down))
    median = (F.col("n") - 1) / 2
    want = F.array_distinct(F.array(*[f(p).cast("bigint") for p in [*thr, median] for f in (F.floor, F.ceil)], *[b.cast("bigint") for b in bound]))
    sums = materialize(sums.withColumn("want", want))
    at = grouped_order_stats(rel, keys, "r", sums.select(*keys, "n", "want"), sorted_rows)
    found = sums.join(at, keys)
    return found.select(*keys, "min_Rx", "max_Rx", "mean_Rx", interpolated(F.col("at"), median).alias("median_Rx"), "sum_rel_neg", "sum_rel_pos", "n_nonneg",
                        F.array(*[interpolated(F.col("at"), p) for p in thr]).alias("thr"), "n_steps", "n_feat",
                        F.array(*[F.element_at("at", b.cast("bigint")) for b in bound]).alias("bound"))


def kept_cells(rel: DataFrame, stats: DataFrame) -> DataFrame:
    """(noun_id, g, feature, t, x, r) for every kept cell of every grid point."""
    j = spread(rel.where(F.col("r") >= 0).join(stats.select("method", "noun_id", "bound"), ["method", "noun_id"]), "noun_id")
    j = j.select("method", "noun_id", "feature", "t", "x", "r", F.posexplode("bound").alias("g", "bound"))
    is_top = F.col("g") < len(K_VALUES)
    keep = F.when(is_top, F.col("r") >= F.col("bound")).otherwise(F.col("r") <= F.col("bound"))
    return j.where(keep).select("method", "noun_id", F.col("g").cast("bigint").alias("g"), "feature", "t", "x", "r")


def feature_metrics(kept: DataFrame, rel: DataFrame) -> DataFrame:
    """Per (noun_id, g, feature): kept count, mean run length (E1), TIC (D10). Runs and Simpson terms come from
    one ordered pass over the kept cells: a run starts where the step before is not kept."""
    k3 = ["method", "noun_id", "g", "feature"]
    ordered = simpson_terms(kept, k3, "t", "r").withColumn("_step", F.col("t") - F.lag("t").over(Window.partitionBy(*k3).orderBy("t")))
    starts = F.count_if(F.col("_step").isNull() | (F.col("_step") != 1))
    num = ordered.groupBy(*k3).agg(simpson_agg().alias("simp_kept"), F.count(F.lit(1)).alias("n_kept"), starts.alias("n_runs"))
    den = simpson_terms(rel.where(F.col("r") >= 0), ["method", "noun_id", "feature"], "t", "r").groupBy(
        "method", "noun_id", "feature").agg(simpson_agg().alias("simp_all"))
    return num.join(den, ["method", "noun_id", "feature"]).select(
        "method", "noun_id", "g", "feature", "n_kept", (F.col("n_kept") / F.col("n_runs")).alias("mean_run"),
        (F.col("simp_kept") / (F.col("simp_all") + F.lit(1e-12))).alias("tic"))


def sample_metrics(fm: DataFrame, stats: DataFrame) -> DataFrame:
    """Per (noun_id, g): means over all F features (features with nothing kept count 0 / run 1)."""
    agg = fm.groupBy("method", "noun_id", "g").agg(F.sum("n_kept").alias("_n"), F.sum("tic").alias("_tic"),
                                         F.sum(F.greatest(F.col("mean_run"), F.lit(1.0))).alias("_run"),
                                         F.count(F.lit(1)).alias("_fk"))
    j = agg.join(stats.select("method", "noun_id", "n_feat", "n_steps"), ["method", "noun_id"])
    nf = F.col("n_feat").cast("double")
    cells = nf * F.col("n_steps")
    return j.select(
        "method", "noun_id", "g",
        (F.col("_n") / nf).alias("mean_n_pts_removed"),
        (F.col("_n") / cells).alias("mean_ratio_pts_removed"),
        (F.col("_tic") / nf).alias("mean_tic"),
        F.bround((F.col("_run") + (nf - F.col("_fk"))) / nf, 0).cast("int").alias("block_size"),
        (F.col("_n") / cells).alias("drop_prob"),
        "n_feat", "n_steps")


def corruption_results(rel: DataFrame, model: Network, state: DataFrame, labelled: DataFrame,
                       encoder: DataFrame, expected: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per (noun_id, g) with the reference's result columns (K2 for every grid point), materialised.
    C2: the rows of metrics, of scores and of the result are counted by the jobs that make them; a sample that
    is in one and not in the others is an error."""
    from chronoscope.session import materialize, materialize_counted
    rel = prepare_rel(rel)
    # intermediates read by several consumers are checkpointed once (bounded: per sample x grid point)
    stats = materialize(relevance_stats(rel))
    kept = kept_cells(rel, stats)
    sm, n_metrics = materialize_counted(sample_metrics(feature_metrics(kept, rel), stats), "metrics")
    keys = ["method", "noun_id", "g"]
    z, n_scores = materialize_counted(corrupted_logits(rel, stats, sm, model, len(K_VALUES), seed), "scores")
    lab = labelled.select("noun_id", F.col("class_idx").alias("label"))
    cls = bounded_broadcast(encoder.select(F.col("class_idx").alias("pred"), F.col("target").alias("class_name")))
    ex = expected if "method" in expected.columns else expected.withColumn("method", F.lit("-"))
    j = (sm.join(z, keys)
         .join(state.select("noun_id", "pred", "s1", "z_arr", "p_arr"), "noun_id")
         .join(stats.drop("thr", "bound", "n_steps", "n_feat", "n_nonneg"), ["method", "noun_id"]).join(lab, "noun_id")
         .join(ex, ["method", "noun_id"]).join(cls, "pred"))
    j = with_softmax(with_softmax(j, F.col("z2"), "_p2"), F.col("z3"), "_p3")

    def argmax(a):
        return F.array_position(a, F.array_max(a)) - 1
    s2 = at(F.col("_p2"), F.col("pred"))
    s3 = at(F.col("_p3"), F.col("pred"))
    gi = F.col("g")
    n_k = len(K_VALUES)
    k_col = F.element_at(_lits(K_VALUES), (gi % n_k + 1).cast("int"))
    out = j.select(
        "method", F.when(gi < n_k, F.lit("top")).otherwise(F.lit("bottom")).alias("mask"), k_col.alias("k"), "noun_id", "class_name",
        "min_Rx", "max_Rx", "mean_Rx", "median_Rx", "mean_n_pts_removed", "mean_ratio_pts_removed", "mean_tic",
        F.col("expected_value").alias("sample_expected_values"), "sum_rel_neg", "sum_rel_pos",
        F.col("s1").alias("score1"), s2.alias("score2"), s3.alias("score3"),
        (F.col("s1") - s2).alias("delta_score1"), (F.col("s1") - s3).alias("delta_score2"),
        (F.col("pred") == F.col("label")).alias("initial_classification"),
        (argmax(F.col("_p2")) == F.col("label")).alias("modified_classification"),
        (argmax(F.col("_p3")) == F.col("label")).alias("random_classification"),
        ((F.col("s1") - s2) / F.col("s1")).alias("metric_score"),
        ((F.col("s1") - s3) / F.col("s1")).alias("metric_score_random"),
        "block_size", "drop_prob")
    out, n_rows = materialize_counted(out, "results")
    if not n_metrics == n_scores == n_rows:
        raise ValueError(f"{n_metrics} rows of metrics, {n_scores} of scores and {n_rows} of both with the samples' state and labels")
    return out


def add_metric_normalised(res: DataFrame, keys=("method",)) -> DataFrame:
    """C1 + D15: the k = 1 row of the same (method, mask, sample), by a window over its grid points
    (one pass, no self-join): score_onlyrel_neg = its score2; metric_normalised = clip(delta_score1 / (score1 - score_onlyrel_neg), 0, 1), k != 1.
    x / 0 follows the reference's float rules: +inf -> 1, -inf -> 0, 0/0 -> null."""
    every_k = Window.partitionBy(*keys, "mask", "noun_id")
    j = res.withColumn("score_onlyrel_neg", F.max(F.when(F.col("k") == 1.0, F.col("score2"))).over(every_k))
    den = F.col("score1") - F.col("score_onlyrel_neg")
    num = F.col("delta_score1")
    raw = F.when(den != 0, num / den).when(num > 0, F.lit(1.0)).when(num < 0, F.lit(0.0))
    mn = F.when(F.col("k") != 1.0, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    return j.withColumn("metric_normalised", mn)
