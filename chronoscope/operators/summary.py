"""Summaries that rank attribution methods.

All inputs are the per-sample result table of the sweep; outputs are small tables
(methods x masks x k). Curves are rows (group, position i, x, y) integrated with the
relational Simpson / trapezoid plans of `chronoscope.functions.integrate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.integrate import simpson, trapezoid

MEAN_COLS = ["mean_n_pts_removed", "mean_ratio_pts_removed", "mean_tic", "score1", "delta_score1", "delta_score2",
             "metric_score", "metric_score_random"]
ACC_COLS = ["initial_classification", "modified_classification", "random_classification"]
MOMENT_K_MAX = 0.95  # skew / kurtosis curves use k = .05 ... .95
XPOWER_WEIGHTS = (0.5, 0.4, 0.1)  # fixed values: diff AUC, AUC skew, AUC kurtosis


def _finite(c: str) -> Column:
    """inf / NaN -> null so that averages skip them."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def summary(res: DataFrame) -> DataFrame:
    """Per (method, mask, k) null-skipping means, metric_normalised (k != 1) and accuracies;
    bottom metric_score clipped at 0 after averaging."""
    agg = res.groupBy("method", "mask", "k").agg(
        *[F.avg(_finite(c)).alias(c) for c in MEAN_COLS],
        F.avg(_finite("metric_normalised")).alias("metric_normalised"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ACC_COLS])
    return agg.withColumn("metric_score", F.when(F.col("mask") == "bottom", F.greatest(F.col("metric_score"), F.lit(0.0)))
                          .otherwise(F.col("metric_score")))


def _curve(summ: DataFrame, mask: str, ycol: str, curve: str, end_y: str | None) -> DataFrame:
    """Rows (method, curve, i, x, y): (0, 0), the summary points by k, optionally (1, last y of end_y)."""
    s = summ.where(F.col("mask") == mask)
    w = Window.partitionBy("method").orderBy("k")
    pts = s.select("method", F.lit(curve).alias("curve"), F.row_number().over(w).alias("i"),
                   F.col("mean_ratio_pts_removed").alias("x"), F.col(ycol).alias("y"))
    origin = s.select("method").distinct().select("method", F.lit(curve).alias("curve"), F.lit(0).alias("i"),
                                                  F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = origin.unionByName(pts)
    if end_y is not None:
        last = s.groupBy("method").agg(F.max_by(end_y, "k").alias("y"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(last.select("method", F.lit(curve).alias("curve"), (F.col("n") + 1).cast("int").alias("i"),
                                          F.lit(1.0).alias("x"), "y"))
    return out


def drop_close_points(curve: DataFrame, min_gap: float = 1e-2) -> DataFrame:
    """Delete every point whose distance to the next x is below min_gap (the left point)."""
    w = Window.partitionBy("method", "curve").orderBy("i")
    gap = F.lead("x", 1).over(w) - F.col("x")
    return curve.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= min_gap)).drop("_gap")


def method_metrics(summ: DataFrame, random_from: str = "integrated_gradients") -> DataFrame:
    """K5: AUCSE_top, F_score per method, and a 'random' row (AUCSE of random corruption)."""
    aucse_curve = drop_close_points(_curve(summ, "top", "metric_score", "aucse", "metric_score"))
    aucse = simpson(aucse_curve, ["method", "curve"], "i", "y", "x", out="v").select("method", F.col("v").alias("AUCSE_top"))
    top = simpson(_curve(summ, "top", "metric_score", "top", None), ["method", "curve"], "i", "y", "x", out="a").select("method", "a")
    bot = simpson(_curve(summ, "bottom", "metric_score", "bottom", None), ["method", "curve"], "i", "y", "x", out="b").select("method", "b")
    den = F.col("a") + (1 - F.col("b"))
    f = top.join(bot, "method").select(
        "method", F.when(den != 0, F.col("a") * (1 - F.col("b")) / den).alias("F_score"))
    rnd_src = summ.where(F.col("method") == random_from)
    rcurve = _curve(rnd_src, "top", "metric_score_random", "random", "metric_score")
    rnd = simpson(rcurve, ["method", "curve"], "i", "y", "x", out="v").select(
        F.lit("random").alias("method"), F.col("v").alias("AUCSE_top"), F.lit(None).cast("double").alias("F_score"))
    return aucse.join(f, "method").unionByName(rnd)


def moment_curves(res: DataFrame) -> DataFrame:
    """K6: population skewness and excess kurtosis of metric_score over samples per (method, k),
    top mask, k <= .95; plus both min-max normalised over the whole methods x k matrix (D21)."""
    top = res.where((F.col("mask") == "top") & (F.col("k") <= MOMENT_K_MAX))
    m = top.groupBy("method", "k").agg(F.skewness("metric_score").alias("skew"), F.kurtosis("metric_score").alias("kurt"))
    allw = Window.partitionBy()  # the matrix is methods x 10: bounded
    out = m
    for c in ("skew", "kurt"):
        lo, hi = F.min(c).over(allw), F.max(c).over(allw)
        out = out.withColumn(f"{c}_norm", F.when(hi != lo, (F.col(c) - lo) / (hi - lo)))
    return out


def auc_moments(curves: DataFrame) -> DataFrame:
    """aucskew = 1 - trapz(k, normalised skew), auckurt = trapz(k, normalised kurtosis)."""
    a = trapezoid(curves, ["method"], "k", "skew_norm", "k", out="_s")
    b = trapezoid(curves, ["method"], "k", "kurt_norm", "k", out="auckurt")
    return a.join(b, "method").select("method", (1 - F.col("_s")).alias("aucskew"), "auckurt")


def diff_auc(summ: DataFrame) -> DataFrame:
    """Trapz over (mean_ratio_pts_removed, metric_score) of top minus that of bottom, 11 k each."""
    t = trapezoid(summ.where(F.col("mask") == "top"), ["method"], "k", "metric_score", "mean_ratio_pts_removed", out="_t")
    b = trapezoid(summ.where(F.col("mask") == "bottom"), ["method"], "k", "metric_score", "mean_ratio_pts_removed", out="_b")
    return t.join(b, "method").select("method", (F.col("_t") - F.col("_b")).alias("diff_auc"))


def _norm(c: str) -> Column:
    allw = Window.partitionBy()
    lo, hi = F.min(c).over(allw), F.max(c).over(allw)
    return F.when(hi != lo, (F.col(c) - lo) / (hi - lo))


def xpower(summ: DataFrame, res: DataFrame) -> DataFrame:
    """0.5 norm(diff_auc) + 0.4 norm(aucskew) + 0.1 norm(auckurt), normalised again."""
    a = auc_moments(moment_curves(res))
    d = diff_auc(summ)
    j = d.join(a, "method")
    w1, w2, w3 = XPOWER_WEIGHTS
    j = j.select("method", "diff_auc", "aucskew", "auckurt",
                 _norm("diff_auc").alias("n_diff"), _norm("aucskew").alias("n_skew"), _norm("auckurt").alias("n_kurt"))
    j = j.withColumn("xpower_raw", F.lit(w1) * F.col("n_diff") + F.lit(w2) * F.col("n_skew") + F.lit(w3) * F.col("n_kurt"))
    return j.withColumn("xpower", _norm("xpower_raw"))


def best_method(mm: DataFrame, summ: DataFrame) -> DataFrame:
    """Method with the largest AUCSE / F score; largest metric score and ratio and their series."""
    m = mm.where(F.col("method") != "random")
    series = F.concat_ws("__", F.col("method"), F.col("mask"))
    s = summ.select(series.alias("series"), "metric_score", "mean_ratio_pts_removed")
    a = m.agg(F.max_by("method", F.struct("AUCSE_top", "method")).alias("best_aucse"),
              F.max_by("method", F.struct("F_score", "method")).alias("best_f"))
    return a.select("best_aucse", "best_f",
                    s.select(F.max("metric_score")).scalar().alias("max_metric_score"),
                    s.select(F.max("mean_ratio_pts_removed")).scalar().alias("max_ratio"),
                    s.select(F.max_by("series", F.struct("mean_ratio_pts_removed", "series"))).scalar().alias("series_max_ratio"))


def drop_histogram(res: DataFrame, bins: int = 20, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Distribution of metric_score per (method, k) on [lo, hi] (top mask);
    bucket 0 below lo, bins + 1 at or above hi."""
    x = F.col("metric_score")
    b = (F.when(x < lo, 0).when(x >= hi, bins + 1)
         .otherwise(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)) + 1)).cast("bigint")
    return res.where(F.col("mask") == "top").groupBy("method", "k", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
