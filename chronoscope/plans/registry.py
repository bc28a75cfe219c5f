"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL.

Every query reads the driver tables (or what Spark derives from them) whole.
Doubles are rounded to 6 decimals in both the Spark result and the SQL text, so
value hashes compare equal across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.functions.rand import sort_key60
from chronoscope.operators import model as M
from chronoscope.operators import prepare as P
from chronoscope.plans import oracle_sql as O
from chronoscope.plans.pipeline import prepared
from chronoscope.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---- A16 / A17: signal sets ---------------------------------------------------------------

for _sig in ("emb", "evt", "sup"):
    def _mk(sig):
        def q(spark, sf_dir):
            pr = prepared(spark, sf_dir, sig)
            return pr.cells.join(pr.targets, "noun_id").select("noun_id", "feature", "t", r6("x").alias("x"), "target")
        return q
    register(f"signal_{_sig}", O.prelude(_sig) + """
SELECT c.noun_id, c.feature, c.t, round(c.x, 6) AS x, t.target FROM cells c JOIN targets t ON c.noun_id = t.noun_id""")(_mk(_sig))


# ---- E3 / I19: split --------------------------------------------------------------------

@register("create_split", O.prelude("emb", O.SPLIT) + "\nSELECT noun_id, split FROM split")
def q_create_split(spark, sf_dir):
    return prepared(spark, sf_dir, "emb").split


@register("split_sizes", O.prelude("evt", O.SPLIT) + "\nSELECT split, count(*) AS n FROM split GROUP BY split")
def q_split_sizes(spark, sf_dir):
    return prepared(spark, sf_dir, "evt").split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- D1 / I1 / I1b: scaler --------------------------------------------------------------

_SCALER_OUT = "SELECT feature, n, round(mean, 6) AS mean, round(s, 2) AS s, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max FROM scaler"


def _scaler_cols(df):
    return df.select("feature", "n", r6("mean").alias("mean"), F.round("s", 2).alias("s"), r6("std").alias("std"),
                     r6("min").alias("min"), r6("max").alias("max"))


@register("fit_scaler", O.prelude("evt", O.SPLIT, O.SCALER) + "\n" + _SCALER_OUT)
def q_fit_scaler(spark, sf_dir):
    return _scaler_cols(prepared(spark, sf_dir, "evt").scaler)


@register("fit_scaler_sup", O.prelude("sup", O.SPLIT, O.SCALER) + "\n" + _SCALER_OUT)
def q_fit_scaler_sup(spark, sf_dir):
    return _scaler_cols(prepared(spark, sf_dir, "sup").scaler)


@register("standardise", O.prelude("evt", O.SPLIT, O.SCALER) + """
SELECT noun_id, feature, t, round(x, 6) AS x FROM std_cells""")
def q_standardise(spark, sf_dir):
    return prepared(spark, sf_dir, "evt").std_cells.select("noun_id", "feature", "t", r6("x").alias("x"))


@register("scale_minmax", O.prelude("sup", O.SPLIT, O.SCALER) + """
SELECT c.noun_id, c.feature, c.t,
       round(CASE WHEN s.max - s.min <> 0 THEN (c.x - s.min) / (s.max - s.min) ELSE 0.0 END, 6) AS x
FROM cells c JOIN scaler s ON c.feature = s.feature""")
def q_scale_minmax(spark, sf_dir):
    pr = prepared(spark, sf_dir, "sup")
    return P.scale_minmax(pr.cells, pr.scaler).select("noun_id", "feature", "t", r6("x").alias("x"))


@register("scale_mean", O.prelude("sup", O.SPLIT, O.SCALER) + """
SELECT c.noun_id, c.feature, c.t, round(c.x - s.mean, 6) AS x FROM cells c JOIN scaler s ON c.feature = s.feature""")
def q_scale_mean(spark, sf_dir):
    pr = prepared(spark, sf_dir, "sup")
    return P.scale_mean(pr.cells, pr.scaler).select("noun_id", "feature", "t", r6("x").alias("x"))


# ---- D2 / D3 / C7: encoder ----------------------------------------------------------------

@register("fit_encoder", O.prelude("emb", O.SPLIT, O.ENCODER) + "\nSELECT target, class_idx, n FROM encoder")
def q_fit_encoder(spark, sf_dir):
    return prepared(spark, sf_dir, "emb").encoder


@register("class_counts", O.prelude("evt") + "\nSELECT target, count(*) AS n FROM targets GROUP BY target")
def q_class_counts(spark, sf_dir):
    return prepared(spark, sf_dir, "evt").targets.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@register("onehot_target", O.prelude("emb", O.SPLIT, O.ENCODER) + """
SELECT l.noun_id, e.class_idx AS class_idx, CAST(CASE WHEN l.class_idx = e.class_idx THEN 1 ELSE 0 END AS INTEGER) AS onehot
FROM labelled l, encoder e""")
def q_onehot_target(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    # one-hot as long form: each sample x each class (classes are a bounded list, exploded per row)
    classes = pr.encoder.select(F.sort_array(F.collect_list("class_idx"))).scalar()
    return pr.labelled.withColumn("_cls", classes).select(
        "noun_id", F.explode("_cls").alias("k"), F.col("class_idx").alias("_lab")).select(
        "noun_id", F.col("k").alias("class_idx"), F.when(F.col("k") == F.col("_lab"), 1).otherwise(0).cast("int").alias("onehot"))


# ---- K0: whole samples through one fitted transform ---------------------------------------

from chronoscope.operators import rows as R  # noqa: E402
from chronoscope.sources import signals as SG_SRC  # noqa: E402

_KEPT_TYPES = ("click", "purchase", "view")


@register("prepare_rows", O.prelude("emb", O.SPLIT, O.SCALER, O.ENCODER) + """
SELECT s.noun_id, l.class_idx, s.feature, s.t, round(s.x, 6) AS x FROM std_cells s JOIN labelled l ON l.noun_id = s.noun_id""")
def q_prepare_rows(spark, sf_dir):
    ready = prepared(spark, sf_dir, "emb").ready
    return R.prepared_cells(ready, ("noun_id", "encoded")).select("noun_id", F.col("encoded").alias("class_idx"), "feature", "t", r6("x").alias("x"))


def _ragged(spark, sf_dir):
    """Signals of unequal length: the transform fitted on the training users, and all users' rows."""
    rows = SG_SRC.rows_from_events(spark, sf_dir)
    train = rows.join(prepared(spark, sf_dir, "evt").train_ids, "noun_id", "left_semi")
    least = rows.select(F.col("noun_id"), F.size("signal").alias("signal_length")).select(P.min_length_quantile_of("signal_length", 0.75)).first()[0]
    asked = R.RowTransform(min_length=least, length=least, cropping="both", keep=_KEPT_TYPES, encoding="onehot")
    return rows, R.fit(train, asked)


@register("prepare_rows_ragged", O.prelude("evt", O.SPLIT) + f"""
, span AS (SELECT noun_id, min(step) AS d0, max(step) AS d1 FROM binned GROUP BY noun_id),
least AS (SELECT CAST(floor(quantile_cont(d1 - d0 + 1, 0.25)) AS BIGINT) AS n FROM span),
long AS (SELECT noun_id, d0, d1, d1 - d0 + 1 AS len FROM span, least WHERE d1 - d0 + 1 >= least.n),
own AS (SELECT c.noun_id, c.feature, c.t - l.d0 AS t, c.x, l.len FROM cells c JOIN long l ON l.noun_id = c.noun_id AND c.t BETWEEN l.d0 AND l.d1),
sc AS (SELECT feature, avg(x) AS mean, CASE WHEN count(x) > 1 THEN stddev_samp(x) ELSE 0.0 END AS std
       FROM own WHERE noun_id IN (SELECT noun_id FROM train_ids) GROUP BY feature),
lab AS (SELECT l.noun_id, coalesce(string_agg(b.channel, ',' ORDER BY b.channel), '0') AS target
        FROM long l LEFT JOIN binned b ON b.noun_id = l.noun_id AND b.step = l.d1 AND b.channel IN {_KEPT_TYPES} GROUP BY l.noun_id),
enc AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS class_idx
        FROM (SELECT DISTINCT target FROM lab WHERE noun_id IN (SELECT noun_id FROM train_ids)))
SELECT o.noun_id, lab.target, CAST(enc.class_idx AS BIGINT) AS class_idx, o.feature, CAST(o.t - ceil((o.len - least.n) / 2.0) AS BIGINT) AS t,
       round(CASE WHEN sc.std <> 0 THEN (o.x - sc.mean) / sc.std ELSE 0.0 END, 6) AS x
FROM own o JOIN sc ON sc.feature = o.feature JOIN lab ON lab.noun_id = o.noun_id JOIN enc ON enc.target = lab.target, least
WHERE o.t >= ceil((o.len - least.n) / 2.0) AND o.t < o.len - floor((o.len - least.n) / 2.0)""")
def q_prepare_rows_ragged(spark, sf_dir):
    rows, transform = _ragged(spark, sf_dir)
    ready = R.prepare_rows(rows, transform)
    cells = R.prepared_cells(ready, ("noun_id", "target", "encoded"))
    return cells.select("noun_id", "target", (F.array_position("encoded", 1) - 1).alias("class_idx"), "feature", "t", r6("x").alias("x"))


# ---- J1 / J2 / J3 / D31: centroid model ----------------------------------------------------

_MODEL_PRE = O.prelude("emb", O.SPLIT, O.SCALER, O.ENCODER, O.MODEL)


@register("centroid_fit", _MODEL_PRE + """
SELECT w.class_idx, w.feature, w.t, round(w.w, 6) AS w, round(b.b, 6) AS b
FROM wmodel w JOIN bmodel b ON w.class_idx = b.class_idx""")
def q_centroid_fit(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return pr.W.join(pr.B, "class_idx").select("class_idx", "feature", "t", r6("w").alias("w"), r6("b").alias("b"))


@register("score_softmax", _MODEL_PRE + "\nSELECT noun_id, class_idx, round(z, 6) AS z, round(p, 6) AS p FROM p1")
def q_score_softmax(spark, sf_dir):
    return prepared(spark, sf_dir, "emb").p1.select("noun_id", "class_idx", r6("z").alias("z"), r6("p").alias("p"))


@register("predictions", _MODEL_PRE + """
SELECT s.noun_id, l.class_idx AS label, s.pred, round(s.s1, 6) AS p_pred, s.pred = l.class_idx AS correct
FROM score1 s JOIN labelled l ON s.noun_id = l.noun_id""")
def q_predictions(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return M.predictions(pr.p1, pr.labelled).select("noun_id", "label", "pred", r6("p_pred").alias("p_pred"), "correct")


@register("evaluate_loss_acc", _MODEL_PRE + """
SELECT count(*) AS n, round(avg(-ln(p.p)), 6) AS loss, round(avg(CASE WHEN s.pred = l.class_idx THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM p1 p JOIN labelled l ON p.noun_id = l.noun_id AND p.class_idx = l.class_idx JOIN score1 s ON s.noun_id = p.noun_id""")
def q_evaluate(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return M.evaluate(pr.p1, pr.labelled).select("n", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"))


# ---- J9-J18: attribution -----------------------------------------------------------------------

from chronoscope.operators.attribute import METHODS  # noqa: E402
from chronoscope.plans.pipeline import relevance  # noqa: E402

for _m in METHODS:
    def _mkrel(m):
        def q(spark, sf_dir):
            return relevance(prepared(spark, sf_dir, "emb"), m).select("noun_id", "feature", "t", r6("r").alias("r"))
        return q
    register(f"attr_{_m}", O.rel_prelude(_m) + "\nSELECT noun_id, feature, t, round(r, 6) AS r FROM rel")(_mkrel(_m))


@register("completeness_delta", O.rel_prelude("deeplift") + """
SELECT r.noun_id, round(sum(r.r), 6) AS sum_r, round(max(s.s1) - max(pb.p), 6) AS delta_p
FROM rel r JOIN score1 s ON s.noun_id = r.noun_id JOIN pbase pb ON pb.class_idx = s.pred GROUP BY r.noun_id""")
def q_completeness(spark, sf_dir):
    """Sum of DeepLIFT relevance versus p(x) - p(baseline) of the predicted class."""
    from chronoscope.plans.pipeline import expected_value
    pr = prepared(spark, sf_dir, "emb")
    rel = relevance(pr, "deeplift").groupBy("noun_id").agg(F.sum("r").alias("sum_r"))
    ev = expected_value(pr, "deeplift")
    return rel.join(pr.score1, "noun_id").join(ev, "noun_id").select(
        "noun_id", r6("sum_r").alias("sum_r"), r6(F.col("s1") - F.col("expected_value")).alias("delta_p"))


# ---- D5-D16, K2, K3: corruption sweep --------------------------------------------------------------

from chronoscope.operators import corrupt as C  # noqa: E402
from chronoscope.plans.pipeline import sweep_results  # noqa: E402

_IG = ["integrated_gradients"]


def _ig_rel(spark, sf_dir):
    rel = relevance(prepared(spark, sf_dir, "emb"), "integrated_gradients").withColumn("method", F.lit("integrated_gradients"))
    return C.prepare_rel(rel)


@register("rel_stats", O.sweep_prelude(_IG) + """
SELECT noun_id, round(min_Rx, 6) AS min_Rx, round(max_Rx, 6) AS max_Rx, round(mean_Rx, 6) AS mean_Rx,
       round(median_Rx, 6) AS median_Rx, round(sum_rel_neg, 6) AS sum_rel_neg, round(sum_rel_pos, 6) AS sum_rel_pos, n_nonneg
FROM stats""")
def q_rel_stats(spark, sf_dir):
    s = C.relevance_stats(_ig_rel(spark, sf_dir))
    return s.select("noun_id", *[r6(c).alias(c) for c in ["min_Rx", "max_Rx", "mean_Rx", "median_Rx", "sum_rel_neg", "sum_rel_pos"]], "n_nonneg")


@register("rel_threshold", O.sweep_prelude(_IG) + "\nSELECT noun_id, CAST(g AS BIGINT) AS g, round(thr, 6) AS thr FROM thr")
def q_rel_threshold(spark, sf_dir):
    s = C.relevance_stats(_ig_rel(spark, sf_dir))
    return s.select("noun_id", F.posexplode("thr").alias("g", "thr")).select(
        "noun_id", F.col("g").cast("bigint").alias("g"), r6("thr").alias("thr"))


@register("kept_points", O.sweep_prelude(_IG) + """
SELECT noun_id, CAST(g AS BIGINT) AS g, feature, count(*) AS n_kept FROM kept GROUP BY noun_id, g, feature""")
def q_kept_points(spark, sf_dir):
    rel = _ig_rel(spark, sf_dir)
    return C.kept_cells(rel, C.relevance_stats(rel)).groupBy("noun_id", "g", "feature").agg(F.count(F.lit(1)).alias("n_kept"))


@register("islands", O.sweep_prelude(_IG) + """
SELECT noun_id, CAST(g AS BIGINT) AS g, feature, round(mean_run, 6) AS mean_run, CAST(n_kept AS BIGINT) AS n_kept, round(tic, 6) AS tic FROM fm""")
def q_islands(spark, sf_dir):
    rel = _ig_rel(spark, sf_dir)
    fm = C.feature_metrics(C.kept_cells(rel, C.relevance_stats(rel)), rel)
    return fm.select("noun_id", "g", "feature", r6("mean_run").alias("mean_run"), F.col("n_kept").cast("bigint").alias("n_kept"), r6("tic").alias("tic"))


@register("tic", O.sweep_prelude(_IG) + """
SELECT noun_id, CAST(g AS BIGINT) AS g, round(mean_n_pts_removed, 6) AS mean_n_pts_removed,
       round(mean_ratio_pts_removed, 6) AS mean_ratio_pts_removed, round(mean_tic, 6) AS mean_tic,
       block_size, round(drop_prob, 6) AS drop_prob FROM sm""")
def q_tic(spark, sf_dir):
    rel = _ig_rel(spark, sf_dir)
    st = C.relevance_stats(rel)
    sm = C.sample_metrics(C.feature_metrics(C.kept_cells(rel, st), rel), st)
    return sm.select("noun_id", "g", *[r6(c).alias(c) for c in ["mean_n_pts_removed", "mean_ratio_pts_removed", "mean_tic"]],
                     "block_size", r6("drop_prob").alias("drop_prob"))


_RESULT_DOUBLES = ["k", "min_Rx", "max_Rx", "mean_Rx", "median_Rx", "mean_n_pts_removed", "mean_ratio_pts_removed", "mean_tic",
                   "sample_expected_values", "sum_rel_neg", "sum_rel_pos", "score1", "score2", "score3", "delta_score1",
                   "delta_score2", "metric_score", "metric_score_random", "drop_prob", "score_onlyrel_neg", "metric_normalised"]
_RESULT_OTHER = ["method", "mask", "noun_id", "class_name", "initial_classification", "modified_classification",
                 "random_classification", "block_size"]


def _result_select_sql(src: str) -> str:
    return "SELECT " + ", ".join(_RESULT_OTHER + [f"round({c}, 6) AS {c}" for c in _RESULT_DOUBLES]) + f" FROM {src}"


def _result_select(df):
    return df.select(*_RESULT_OTHER, *[r6(c).alias(c) for c in _RESULT_DOUBLES])


from chronoscope.plans.pipeline import SWEEP_METHODS  # noqa: E402

_ALL = list(SWEEP_METHODS)


@register("corruption_sweep", O.sweep_prelude(_ALL) + "\n" + _result_select_sql("resn"))
def q_corruption_sweep(spark, sf_dir):
    return _result_select(sweep_results(prepared(spark, sf_dir, "emb"), tuple(_ALL)))


# ---- K4-K9: summaries ---------------------------------------------------------------------------

from chronoscope.operators import summary as S  # noqa: E402

_SUM_PRE = O.sweep_prelude(_ALL, "emb", O.SUMMARY)
_SUM_DOUBLES = ["k"] + S.MEAN_COLS + ["metric_normalised"] + S.ACC_COLS


def _res(spark, sf_dir):
    return sweep_results(prepared(spark, sf_dir, "emb"), tuple(_ALL))


def _summ(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    key = "_summary"
    if key not in pr.__dict__:
        from chronoscope.plans.pipeline import materialize
        pr.__dict__[key] = materialize(S.summary(_res(spark, sf_dir)))
    return pr.__dict__[key]


@register("metric_normalised", O.sweep_prelude(_ALL) + """
SELECT method, mask, round(k, 6) AS k, noun_id, round(score_onlyrel_neg, 6) AS score_onlyrel_neg,
       round(metric_normalised, 6) AS metric_normalised FROM resn""")
def q_metric_normalised(spark, sf_dir):
    return _res(spark, sf_dir).select("method", "mask", r6("k").alias("k"), "noun_id", r6("score_onlyrel_neg").alias("score_onlyrel_neg"),
                                      r6("metric_normalised").alias("metric_normalised"))


@register("summary", _SUM_PRE + "\nSELECT method, mask, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUM_DOUBLES) + " FROM summ")
def q_summary(spark, sf_dir):
    return _summ(spark, sf_dir).select("method", "mask", *[r6(c).alias(c) for c in _SUM_DOUBLES])


_MM_PRE = O.sweep_prelude(_ALL, "emb", O.SUMMARY, O.METRICS)


def _mm(spark, sf_dir):
    return S.method_metrics(_summ(spark, sf_dir))


@register("method_metrics", _MM_PRE + "\nSELECT method, round(AUCSE_top, 6) AS AUCSE_top, round(F_score, 6) AS F_score FROM mmetrics")
def q_method_metrics(spark, sf_dir):
    return _mm(spark, sf_dir).select("method", r6("AUCSE_top").alias("AUCSE_top"), r6("F_score").alias("F_score"))


@register("aucse", _MM_PRE + "\nSELECT method, round(AUCSE_top, 6) AS AUCSE_top FROM mmetrics WHERE method <> 'random'")
def q_aucse(spark, sf_dir):
    return _mm(spark, sf_dir).where(F.col("method") != "random").select("method", r6("AUCSE_top").alias("AUCSE_top"))


@register("f_score", _MM_PRE + "\nSELECT method, round(F_score, 6) AS F_score FROM mmetrics WHERE method <> 'random'")
def q_f_score(spark, sf_dir):
    return _mm(spark, sf_dir).where(F.col("method") != "random").select("method", r6("F_score").alias("F_score"))


@register("random_row", _MM_PRE + "\nSELECT method, round(AUCSE_top, 6) AS AUCSE_top FROM mmetrics WHERE method = 'random'")
def q_random_row(spark, sf_dir):
    return _mm(spark, sf_dir).where(F.col("method") == "random").select("method", r6("AUCSE_top").alias("AUCSE_top"))


_X_PRE = O.sweep_prelude(_ALL, "emb", O.SUMMARY, O.MOMENTS)


@register("moment_curves", _X_PRE + """
SELECT method, round(k, 6) AS k, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(skew_norm, 6) AS skew_norm,
       round(kurt_norm, 6) AS kurt_norm FROM moments""")
def q_moment_curves(spark, sf_dir):
    m = S.moment_curves(_res(spark, sf_dir))
    return m.select("method", *[r6(c).alias(c) for c in ["k", "skew", "kurt", "skew_norm", "kurt_norm"]])


@register("auc_moments", _X_PRE + "\nSELECT method, round(aucskew, 6) AS aucskew, round(auckurt, 6) AS auckurt FROM aucm")
def q_auc_moments(spark, sf_dir):
    a = S.auc_moments(S.moment_curves(_res(spark, sf_dir)))
    return a.select("method", r6("aucskew").alias("aucskew"), r6("auckurt").alias("auckurt"))


@register("diff_auc", _X_PRE + "\nSELECT method, round(diff_auc, 6) AS diff_auc FROM dauc")
def q_diff_auc(spark, sf_dir):
    return S.diff_auc(_summ(spark, sf_dir)).select("method", r6("diff_auc").alias("diff_auc"))


@register("xpower", _X_PRE + """
SELECT method, round(diff_auc, 6) AS diff_auc, round(aucskew, 6) AS aucskew, round(auckurt, 6) AS auckurt,
       round(xpower_raw, 6) AS xpower_raw, round(xpower, 6) AS xpower FROM xpow""")
def q_xpower(spark, sf_dir):
    x = S.xpower(_summ(spark, sf_dir), _res(spark, sf_dir))
    return x.select("method", *[r6(c).alias(c) for c in ["diff_auc", "aucskew", "auckurt", "xpower_raw", "xpower"]])


@register("best_method", _MM_PRE + """
SELECT (SELECT first(method ORDER BY AUCSE_top DESC, method DESC) FROM mmetrics WHERE method <> 'random') AS best_aucse,
       (SELECT first(method ORDER BY F_score DESC, method DESC) FROM mmetrics WHERE method <> 'random') AS best_f,
       round((SELECT max(metric_score) FROM summ), 6) AS max_metric_score,
       round((SELECT max(mean_ratio_pts_removed) FROM summ), 6) AS max_ratio,
       (SELECT first(method || '__' || mask ORDER BY mean_ratio_pts_removed DESC, method || '__' || mask DESC) FROM summ) AS series_max_ratio""")
def q_best_method(spark, sf_dir):
    b = S.best_method(_mm(spark, sf_dir), _summ(spark, sf_dir))
    return b.select("best_aucse", "best_f", r6("max_metric_score").alias("max_metric_score"), r6("max_ratio").alias("max_ratio"),
                    "series_max_ratio")


@register("drop_histogram", O.sweep_prelude(_ALL) + """
SELECT method, round(k, 6) AS k, CAST(CASE WHEN metric_score < -1.0 THEN 0 WHEN metric_score >= 1.0 THEN 21
            ELSE floor((metric_score - (-1.0)) / 2.0 * 20) + 1 END AS BIGINT) AS bucket, count(*) AS n
FROM resn WHERE mask = 'top' GROUP BY ALL""")
def q_drop_histogram(spark, sf_dir):
    return S.drop_histogram(_res(spark, sf_dir)).select("method", r6("k").alias("k"), "bucket", "n")


# ---- I2-I15, D33: augmentation on the events signal set -------------------------------------------

from chronoscope.operators import augment as AG  # noqa: E402

_EVT = O.prelude("evt")


def _evt_cells(spark, sf_dir):
    return prepared(spark, sf_dir, "evt").cells


def _cells_out(df):
    return df.select("noun_id", "feature", "t", r6("x").alias("x"))


_OUT = "SELECT noun_id, feature, t, round(x, 6) AS x FROM "


@register("jitter", _EVT + "\n" + _OUT + f"""(SELECT noun_id, feature, t,
   x + {O.normal_sql("'jitter'", 'noun_id', 'feature', 't')} * stddev_samp(x) OVER (PARTITION BY noun_id, feature) * 0.1 AS x FROM cells)""")
def q_jitter(spark, sf_dir):
    return _cells_out(AG.jitter(_evt_cells(spark, sf_dir)))


@register("scaling", _EVT + "\n" + _OUT + f"""(SELECT noun_id, feature, t,
   x * (1.0 + 0.1 * {O.normal_sql("'scaling'", 'noun_id', 'feature')}) AS x FROM cells)""")
def q_scaling(spark, sf_dir):
    return _cells_out(AG.scaling(_evt_cells(spark, sf_dir)))


@register("flip_y", _EVT + "\n" + _OUT + f"""(SELECT noun_id, feature, t,
   x * CASE WHEN {O.u_sql("'flip'", 'noun_id', 'feature')} < 0.5 THEN -1.0 ELSE 1.0 END AS x FROM cells)""")
def q_flip_y(spark, sf_dir):
    return _cells_out(AG.flip_y(_evt_cells(spark, sf_dir)))


@register("shuffle_channel", _EVT + f""",
feats AS (SELECT DISTINCT feature FROM cells),
perm AS (SELECT feature AS src, row_number() OVER (ORDER BY {O.u_sql("'shuffle_channel'", 'feature')}, feature) - 1 AS dst FROM feats),
rnk AS (SELECT feature AS pos, row_number() OVER (ORDER BY feature) - 1 AS dst FROM feats),
m AS (SELECT p.src, r.pos AS new_feature FROM perm p JOIN rnk r ON p.dst = r.dst)
SELECT c.noun_id, m.new_feature AS feature, c.t, round(c.x, 6) AS x FROM cells c JOIN m ON c.feature = m.src""")
def q_shuffle_channel(spark, sf_dir):
    return _cells_out(AG.shuffle_channel(_evt_cells(spark, sf_dir)))


@register("window_slice", _EVT + f""",
ser AS (SELECT noun_id, feature, max(t) + 1 AS nT FROM cells GROUP BY 1, 2),
idx AS (SELECT noun_id, feature, nT, CAST(ceil(0.8 * nT) AS BIGINT) AS L, unnest(range(nT)) AS t FROM ser),
src AS (SELECT noun_id, feature, t, CASE WHEN L >= nT THEN t
          ELSE CAST(floor({O.u_sql("'window_slice'")} * (nT - L)) AS BIGINT) + CAST(floor(t * L / nT) AS BIGINT) END AS s FROM idx)
SELECT src.noun_id, src.feature, CAST(src.t AS BIGINT) AS t, round(c.x, 6) AS x FROM src
JOIN cells c ON c.noun_id = src.noun_id AND c.feature = src.feature AND c.t = src.s""")
def q_window_slice(spark, sf_dir):
    return _cells_out(AG.window_slice(_evt_cells(spark, sf_dir)))


@register("drop_block", _EVT + "\n" + _OUT + "(SELECT noun_id, feature, t, CASE WHEN m THEN 0.0 ELSE x END AS x FROM "
          + O.block_mask_sql("cells", 0.1, 7, 1.1, "drop_block") + ")")
def q_drop_block(spark, sf_dir):
    return _cells_out(AG.drop_block(_evt_cells(spark, sf_dir)))


@register("random_block", _EVT + "\n" + _OUT + f"""(SELECT noun_id, feature, t,
   CASE WHEN m THEN {O.normal_sql("'random_block_n'", 'noun_id', 'feature', 't')} ELSE x END AS x FROM """
          + O.block_mask_sql("cells", 0.1, 7, 1.1, "random_block") + ")")
def q_random_block(spark, sf_dir):
    return _cells_out(AG.random_block(_evt_cells(spark, sf_dir)))


@register("permute_block", _EVT + f""",
pm AS (SELECT noun_id, feature, row_number() OVER (PARTITION BY noun_id, feature
         ORDER BY {O.u_sql("'permute'", 'noun_id', 'feature', 't')}, t, x) - 1 AS pos, x AS px FROM cells),
mk AS """ + O.block_mask_sql("cells", 0.1, 7, 1.2, "permute_block") + """
SELECT mk.noun_id, mk.feature, mk.t, round(CASE WHEN mk.m THEN pm.px ELSE mk.x END, 6) AS x
FROM mk JOIN pm ON pm.noun_id = mk.noun_id AND pm.feature = mk.feature AND pm.pos = mk.t""")
def q_permute_block(spark, sf_dir):
    return _cells_out(AG.permute_block(_evt_cells(spark, sf_dir)))


@register("block_enforce", _EVT + "," + O.enforce_sql(0.1, 7) + "\n" + _OUT + "eb_out")
def q_block_enforce(spark, sf_dir):
    return _cells_out(AG.random_block_enforce(_evt_cells(spark, sf_dir)))


@register("signal_power", _EVT + """
SELECT noun_id, feature, round(CASE WHEN avg(x * x) > 0 THEN 10.0 * log10(avg(x * x)) END, 6) AS power_db
FROM cells GROUP BY noun_id, feature""")
def q_signal_power(spark, sf_dir):
    return AG.signal_power(_evt_cells(spark, sf_dir)).select("noun_id", "feature", r6("power_db").alias("power_db"))


@register("add_noise_snr", _EVT + "\n" + _OUT + f"""(SELECT noun_id, feature, t,
   x + sqrt(CASE WHEN pw > 0 THEN power(10.0, (10.0 * log10(pw) - 20.0) / 10.0) ELSE 0.0 END)
       * {O.normal_sql("'snr'", 'noun_id', 'feature', 't')} AS x
   FROM (SELECT *, avg(x * x) OVER (PARTITION BY noun_id, feature) AS pw FROM cells))""")
def q_add_noise_snr(spark, sf_dir):
    return _cells_out(AG.add_noise_snr(_evt_cells(spark, sf_dir)))


@register("inject_pattern", _EVT + f"""
SELECT noun_id, feature, t, round(x + CASE WHEN i >= 0 AND i < n THEN sin({2 * 3.141592653589793 * 3!r} * i / greatest(n - 1, 1)) ELSE 0.0 END, 6) AS x,
       CAST(st AS BIGINT) AS pattern_start
FROM (SELECT *, t - st AS i FROM (SELECT *, floor({O.u_sql("'pattern'", 'noun_id')} * (nT - n + 1)) AS st FROM (
      SELECT *, floor(0.5 * nT) AS n FROM (SELECT *, max(t) OVER (PARTITION BY noun_id, feature) + 1 AS nT FROM cells))))""")
def q_inject_pattern(spark, sf_dir):
    df = AG.inject_pattern(_evt_cells(spark, sf_dir))
    return df.select("noun_id", "feature", "t", r6("x").alias("x"), "pattern_start")


_SUPPORT, _F_SUPPORT, _F_BASE = 10, (1, 5), (2.0, 4.0)
_PLAN_SQL = _EVT + f""",
pat AS (
  SELECT *, CASE WHEN place < 2 THEN 'sine' WHEN {O.u_sql("'pat_w'", 'noun_id', 'feature')} < 0.5 THEN 'line' ELSE 'square' END AS wave,
         CAST(floor({O.u_sql("'pat_f'", 'noun_id', 'feature')} * {_F_SUPPORT[1] - _F_SUPPORT[0]}) AS BIGINT) + {_F_SUPPORT[0]} AS fs,
         {O.u_sql("'pat_b'", 'noun_id', 'feature')} * {_F_BASE[1] - _F_BASE[0]} + {_F_BASE[0]} AS fb,
         CAST(floor({O.u_sql("'pat_s'", 'noun_id', 'feature')} * (greatest(nT - {_SUPPORT}, 0) + 1)) AS BIGINT) AS st
  FROM (SELECT noun_id, feature, max(t) + 1 AS nT, row_number() OVER (PARTITION BY noun_id ORDER BY {O.key60_sql("'pat_o'", 'noun_id', 'feature')}, feature) - 1 AS place
        FROM cells GROUP BY noun_id, feature))"""


def _pattern_plan(spark, sf_dir):
    return AG.pattern_plan(_evt_cells(spark, sf_dir), _SUPPORT, _F_SUPPORT, _F_BASE)


@register("inject_patterns", _PLAN_SQL + f"""
SELECT noun_id, feature, t, wave, round(x + CASE WHEN i < 0 OR i >= {_SUPPORT} OR wave = 'line' THEN 0.0 WHEN wave = 'sine' THEN sin(ph) ELSE sign(sin(ph)) END, 6) AS x
FROM (SELECT c.*, p.wave, c.t - p.st AS i, {2 * 3.141592653589793!r} * p.fs * (c.t - p.st) / {_SUPPORT - 1} AS ph FROM cells c JOIN pat p ON p.noun_id = c.noun_id AND p.feature = c.feature)""")
def q_inject_patterns(spark, sf_dir):
    """Sine, square and line on the given signals."""
    plan = _pattern_plan(spark, sf_dir)
    out = AG.inject_patterns(_evt_cells(spark, sf_dir), plan, _SUPPORT)
    return out.join(plan.select("noun_id", "feature", "wave"), ["noun_id", "feature"]).select("noun_id", "feature", "t", "wave", r6("x").alias("x"))


@register("pattern_truth", _PLAN_SQL + """,
truth AS (SELECT noun_id, string_agg(st, ',' ORDER BY place) AS pos_sin_wave, string_agg(feature, ',' ORDER BY place) AS feature_idx_sin_wave,
                 CAST(sum(fs) AS BIGINT) AS f_sine_sum, sum(fs / fb) AS f_sine_ratio FROM pat WHERE wave = 'sine' GROUP BY noun_id),
thr AS (SELECT quantile_cont(CAST(f_sine_sum AS DOUBLE), [0.5, 1.0]) AS qs, quantile_cont(f_sine_ratio, [0.5, 1.0]) AS qr FROM truth)
SELECT noun_id, pos_sin_wave, feature_idx_sin_wave, f_sine_sum, round(f_sine_ratio, 6) AS f_sine_ratio,
       CASE WHEN f_sine_sum <= qs[1] THEN '0' ELSE '1' END AS target_sum, CASE WHEN f_sine_ratio <= qr[1] THEN '0' ELSE '1' END AS target_ratio
FROM truth, thr""")
def q_pattern_truth(spark, sf_dir):
    """Where the sines are, the sums of their frequencies, and the labels made of them."""
    truth = AG.pattern_truth(_pattern_plan(spark, sf_dir))
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("pos_sin_wave", "feature_idx_sin_wave")]
    return truth.join(AG.pattern_labels(truth), "noun_id").select("noun_id", *listed, "f_sine_sum", r6("f_sine_ratio").alias("f_sine_ratio"), "target_sum", "target_ratio")


@register("weighted_choice", _EVT + f""",
vals AS (SELECT event_type AS value, count(*) AS weight FROM events GROUP BY event_type),
cum AS (SELECT value, sum(weight) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS cw, sum(weight) OVER () AS tot FROM vals),
d AS (SELECT noun_id, dr.draw, {O.u_sql("'choice'", 'noun_id', 'dr.draw')} * (SELECT max(tot) FROM cum) AS uu
      FROM (SELECT DISTINCT noun_id FROM cells) CROSS JOIN range(3) AS dr(draw))
SELECT d.noun_id, CAST(d.draw AS INTEGER) AS draw, first(c.value ORDER BY c.cw) AS value FROM d JOIN cum c ON c.cw > d.uu
GROUP BY d.noun_id, d.draw""")
def q_weighted_choice(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    vals = ev.groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    ids = _evt_cells(spark, sf_dir).select("noun_id").distinct()
    return AG.weighted_choice(ids, vals, 3)


# ---- B10 / B11 / D4 / I16 / B9 / G2: cropping, quantile labels, class selection -------------------------

for _crop in ("end", "start", "both"):
    def _mkcrop(crop):
        def q(spark, sf_dir):
            return _cells_out(P.resize(_evt_cells(spark, sf_dir), 25, crop))
        return q
    register(f"resize_{_crop}", _EVT + "\n" + O.resize_sql(25, _crop))(_mkcrop(_crop))


@register("min_length_quantile", O.prelude("sup", O.SPLIT) + """
SELECT CAST(floor(quantile_cont(L, 1.0 - 0.9)) AS BIGINT) AS min_length FROM (
  SELECT noun_id, max(t) + 1 AS L FROM cells WHERE noun_id IN (SELECT noun_id FROM train_ids) GROUP BY noun_id)""")
def q_min_length_quantile(spark, sf_dir):
    pr = prepared(spark, sf_dir, "sup")
    lengths = P.sample_lengths(pr.cells.join(pr.train_ids, "noun_id", "left_semi"))
    return spark.range(1).select(P.min_length_quantile(lengths, 0.9).alias("min_length"))


@register("at_least_long", O.prelude("evt") + """
SELECT noun_id, feature, t, round(x, 6) AS x FROM cells
WHERE noun_id IN (SELECT CAST(user_id AS BIGINT) FROM events GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) >= 27)""")
def q_at_least_long(spark, sf_dir):
    """B2: samples whose length (here: days with events, a stored column of the entity) reaches a minimum."""
    events = read_table(spark, sf_dir, "events")
    lengths = events.groupBy(F.col("user_id").cast("bigint").alias("noun_id")).agg(F.count_distinct(F.to_date("ts")).alias("signal_length"))
    return _cells_out(P.at_least_long(prepared(spark, sf_dir, "evt").cells, lengths, 27))


@register("binary_target", """
SELECT CAST(l_suppkey AS BIGINT) AS noun_id, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN '1' ELSE '0' END AS target
FROM lineitem GROUP BY l_suppkey""")
def q_binary_target(spark, sf_dir):
    """H6: multi-label samples to one against the rest."""
    return P.binary_target(_supplier_labels(spark, sf_dir), "R")


@register("label_by_quantile", O.prelude("sup") + """
SELECT t.noun_id, round(s.total, 6) AS total, t.target FROM targets t JOIN totals s ON s.noun_id = t.noun_id""")
def q_label_by_quantile(spark, sf_dir):
    pr = prepared(spark, sf_dir, "sup")
    totals = pr.cells.groupBy("noun_id").agg(F.sum("x").alias("total"))
    return pr.targets.join(totals, "noun_id").select("noun_id", r6("total").alias("total"), "target")


@register("class_thresholds", O.prelude("sup") + "\nSELECT round(q[1], 6) AS q50, round(q[2], 6) AS q100 FROM cls_thr")
def q_class_thresholds(spark, sf_dir):
    from chronoscope.functions.ranking import exact_quantiles
    totals = prepared(spark, sf_dir, "sup").cells.groupBy("noun_id").agg(F.sum("x").alias("total"))
    q50, q100 = exact_quantiles(totals, "total", (0.5, 1.0))
    return spark.range(1).select(r6(F.lit(q50)).alias("q50"), r6(F.lit(q100)).alias("q100"))


_KEEP = ["A", "R"]


def _supplier_labels(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_returnflag")
    return li.groupBy(F.col("l_suppkey").cast("bigint").alias("noun_id")).agg(F.collect_set("l_returnflag").alias("labels"))


@register("select_class", """
SELECT CAST(l_suppkey AS BIGINT) AS noun_id,
       coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_returnflag IN ('A', 'R')), '0') AS target
FROM lineitem GROUP BY l_suppkey""")
def q_select_class(spark, sf_dir):
    return P.select_class(_supplier_labels(spark, sf_dir), _KEEP)


@register("label_difference", "SELECT DISTINCT l_returnflag AS label FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')")
def q_label_difference(spark, sf_dir):
    labels = _supplier_labels(spark, sf_dir).select(F.explode("labels").alias("label")).distinct()
    keep = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in _KEEP])).alias("label"))
    return labels.subtract(keep)


# ---- B19 / B18 / F6 / F7 / G1: batching, shards, epochs, union of splits --------------------------------

@register("batch_limit", O.prelude("emb", O.SPLIT) + f"""
SELECT noun_id, CAST(floor((pos - 1) / 16) AS BIGINT) AS batch_id FROM (
  SELECT noun_id, row_number() OVER (ORDER BY {O.key60_sql("'batch'", 'noun_id')}, noun_id) AS pos FROM train_ids)
WHERE pos <= floor((SELECT count(*) FROM train_ids) / 16) * 16""")
def q_batch_limit(spark, sf_dir):
    return P.batch_limit(prepared(spark, sf_dir, "emb").train_ids, 16)


@register("shard_assign", O.prelude("emb") + f"""
SELECT noun_id, CAST(CAST(('0x' || substr(md5(concat_ws('|', '42', 'shard', CAST(noun_id AS VARCHAR))), 1, 8)) AS BIGINT) % 4 AS INTEGER) AS shard
FROM targets""")
def q_shard_assign(spark, sf_dir):
    ids = prepared(spark, sf_dir, "emb").targets.select("noun_id")
    return P.shard_assign(ids, 4).select("noun_id", F.col("shard").cast("int").alias("shard"))


@register("epoch_shuffle", O.prelude("emb") + f"""
SELECT CAST(e.epoch AS INTEGER) AS epoch, t.noun_id,
       row_number() OVER (PARTITION BY e.epoch ORDER BY {O.key60_sql("'epoch'", 'e.epoch', 't.noun_id')}, t.noun_id) AS pos
FROM targets t CROSS JOIN range(3) AS e(epoch)""")
def q_epoch_shuffle(spark, sf_dir):
    ids = prepared(spark, sf_dir, "emb").targets.select("noun_id")
    return P.epoch_order(ids, 3).select(F.col("epoch").cast("int").alias("epoch"), "noun_id", "pos")


@register("union_splits", O.prelude("emb", O.SPLIT) + "\nSELECT split, count(*) AS n, count(DISTINCT noun_id) AS n_ids FROM split GROUP BY split")
def q_union_splits(spark, sf_dir):
    sp = prepared(spark, sf_dir, "emb").split
    parts = [sp.where(F.col("split") == s) for s in P.SPLIT_NAMES]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("noun_id").alias("n_ids"))


# ---- J6-J8 / D18 / D19 / F2 / F3: baselines -------------------------------------------------------------

from chronoscope.operators import attribute as A  # noqa: E402
from chronoscope.plans.pipeline import _state, expected_value, materialize  # noqa: E402

_BASE_PRE = O.prelude("emb", O.SPLIT, O.SCALER, O.ENCODER, O.MODEL, O.BASES)


@register("baseline_mean", _BASE_PRE + "\nSELECT feature, t, round(avg(x), 6) AS xb FROM test_cells GROUP BY feature, t")
def q_baseline_mean(spark, sf_dir):
    return A.baseline_mean(prepared(spark, sf_dir, "emb").test_cells).select("feature", "t", r6("xb").alias("xb"))


@register("baseline_random", _BASE_PRE + "\nSELECT feature, t, round(xb, 6) AS xb FROM base")
def q_baseline_random(spark, sf_dir):
    _, brand, _ = _state(prepared(spark, sf_dir, "emb"))
    return brand.select("feature", "t", r6("xb").alias("xb"))


@register("baseline_sample", _BASE_PRE + "\nSELECT CAST(bid AS BIGINT) AS bid, noun_id FROM bsel")
def q_baseline_sample(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return A.baseline_ids(pr.test_cells)


@register("baseline_zeros", _BASE_PRE + "\nSELECT DISTINCT feature, t, 0.0::DOUBLE AS xb FROM wmodel")
def q_baseline_zeros(spark, sf_dir):
    """J5."""
    return A.baseline_zeros(prepared(spark, sf_dir, "emb").W)


@register("random_single", _BASE_PRE + f"""
SELECT noun_id FROM (SELECT DISTINCT noun_id FROM test_cells) ORDER BY {O.key60_sql("'single'", 'noun_id')}, noun_id LIMIT 1""")
def q_random_single(spark, sf_dir):
    ids = prepared(spark, sf_dir, "emb").test_ids
    return ids.withColumn("_h", A.sort_key60(42, F.lit("single"), "noun_id")).orderBy("_h", "noun_id").limit(1).select("noun_id")


@register("expected_value", _BASE_PRE + "," + ",".join(
    O.EXPECTED[k].replace("expv AS (", f"expv_{k} AS (", 1) for k in ("single", "set")) + """
SELECT 'single' AS kind, noun_id, round(expected_value, 6) AS expected_value FROM expv_single
UNION ALL SELECT 'set' AS kind, noun_id, round(expected_value, 6) AS expected_value FROM expv_set""")
def q_expected_value(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    a = expected_value(pr, "integrated_gradients").select(F.lit("single").alias("kind"), "noun_id", "expected_value")
    b = expected_value(pr, "gradshap").select(F.lit("set").alias("kind"), "noun_id", "expected_value")
    return a.unionByName(b).select("kind", "noun_id", r6("expected_value").alias("expected_value"))


# ---- A17: long cells <-> per-sample tensor ---------------------------------------------------------------

@register("pivot_cells", _EVT + """
SELECT noun_id, feature, t, round(x, 6) AS x, max(t) OVER (PARTITION BY noun_id) + 1 AS n_steps,
       count(DISTINCT feature) OVER (PARTITION BY noun_id) AS n_feat FROM cells""")
def q_pivot_cells(spark, sf_dir):
    from chronoscope.sources.signals import cells_to_tensor, tensor_to_cells
    tens = cells_to_tensor(_evt_cells(spark, sf_dir))
    back = tensor_to_cells(tens)
    return back.join(tens.select("noun_id", F.size("signal").cast("bigint").alias("n_steps"),
                                 F.size(F.col("signal")[0]).cast("bigint").alias("n_feat")), "noun_id").select(
        "noun_id", "feature", "t", r6("x").alias("x"), "n_steps", "n_feat")


# ---- D9 / K8: fraction of relevant points, corruption overlay ----------------------------------------------

@register("frac_pts", O.sweep_prelude(_IG) + """,
fstat AS (SELECT noun_id, feature, var_pop(r) AS v, count(*) AS nn FROM relr WHERE r >= 0 GROUP BY noun_id, feature)
SELECT f.noun_id, CAST(f.g AS BIGINT) AS g, f.feature,
       round(CASE WHEN s.v < 1e-8 THEN 0.0 ELSE f.n_kept / (s.nn + 1e-12) END, 6) AS frac_pts_rel
FROM fm f JOIN fstat s ON s.noun_id = f.noun_id AND s.feature = f.feature""")
def q_frac_pts(spark, sf_dir):
    rel = _ig_rel(spark, sf_dir)
    fm = C.feature_metrics(C.kept_cells(rel, C.relevance_stats(rel)), rel)
    fs = rel.where(F.col("r") >= 0).groupBy("noun_id", "feature").agg(F.var_pop("r").alias("v"), F.count(F.lit(1)).alias("nn"))
    return fm.join(fs, ["noun_id", "feature"]).select(
        "noun_id", "g", "feature",
        r6(F.when(F.col("v") < 1e-8, F.lit(0.0)).otherwise(F.col("n_kept") / (F.col("nn") + F.lit(1e-12)))).alias("frac_pts_rel"))


@register("overlay", O.sweep_prelude(_IG) + f""",
one AS (SELECT noun_id FROM (SELECT DISTINCT noun_id FROM relr) ORDER BY {O.key60_sql("'single'", 'noun_id')}, noun_id LIMIT 1),
othr AS (SELECT list(r ORDER BY r)[count(*) - 10 * (count(*) - 1) // 100] AS thr FROM relr WHERE r >= 0 AND noun_id IN (SELECT noun_id FROM one))
SELECT r.noun_id, r.feature, r.t, round(r.x, 6) AS x, round(r.r, 6) AS r, (r.r >= 0 AND r.r >= o.thr) AS kept,
       round(CASE WHEN r.r >= 0 AND r.r >= o.thr THEN {O.normal_sql("'overlay'", 'r.noun_id', 'r.feature', 'r.t')} ELSE r.x END, 6) AS x_corrupted
FROM relr r, othr o WHERE r.noun_id IN (SELECT noun_id FROM one)""")
def q_overlay(spark, sf_dir):
    """K8: original, relevance and corrupted values of one sample (the first test sample in md5
    order) at k = .1, top mask."""
    rel = _ig_rel(spark, sf_dir)
    one = rel.select("noun_id").distinct().withColumn("_h", A.sort_key60(42, F.lit("single"), "noun_id")).orderBy("_h", "noun_id").limit(1)
    s = rel.join(one.select("noun_id"), "noun_id", "left_semi")
    ranked = F.sort_array(F.collect_list("r"))  # one sample
    thr = s.where(F.col("r") >= 0).select(F.element_at(ranked, (F.size(ranked) - F.floor(F.lit(10) * (F.size(ranked) - 1) / 100)).cast("int"))).scalar()
    kept = (F.col("r") >= 0) & (F.col("r") >= thr)
    return s.select("noun_id", "feature", "t", r6("x").alias("x"), r6("r").alias("r"), kept.alias("kept"),
                    r6(F.when(kept, A.normal(42, F.lit("overlay"), "noun_id", "feature", "t")).otherwise(F.col("x"))).alias("x_corrupted"))


# ---- J4 / D32: model selection over the temperature, running best ----------------------------------------

_TAUS = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0]


@register("model_select", O.prelude("emb", O.SPLIT, O.SCALER, O.ENCODER, O.MODEL) + f""",
val_cells AS (SELECT * FROM std_cells WHERE noun_id IN (SELECT noun_id FROM split WHERE split = 'val')),
zv AS (SELECT c.noun_id, w.class_idx, sum(c.x * w.w) + max(b.b) AS z
       FROM val_cells c JOIN wmodel w ON c.feature = w.feature AND c.t = w.t JOIN bmodel b ON w.class_idx = b.class_idx
       GROUP BY c.noun_id, w.class_idx),
cand AS (SELECT * FROM (VALUES {", ".join(f"({i}, {v!r})" for i, v in enumerate(_TAUS))}) v(cand, tau)),
zt AS (SELECT c.cand, c.tau, z.noun_id, z.class_idx, z.z * c.tau / {O.TAU!r} AS z FROM zv z, cand c),
ztc AS (SELECT *, z - max(z) OVER (PARTITION BY cand, noun_id) AS zc FROM zt),
pt AS (SELECT cand, tau, noun_id, class_idx, exp(zc) / sum(exp(zc)) OVER (PARTITION BY cand, noun_id) AS p FROM ztc),
ev AS (SELECT p.cand, p.tau, p.noun_id, max(CASE WHEN p.class_idx = l.class_idx THEN p.p END) AS pl,
              first(p.class_idx ORDER BY p.p DESC, p.class_idx) = max(l.class_idx) AS ok
       FROM pt p JOIN labelled l ON l.noun_id = p.noun_id GROUP BY p.cand, p.tau, p.noun_id),
sel AS (SELECT cand, tau, avg(-ln(pl)) AS loss, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS accuracy FROM ev GROUP BY cand, tau)
SELECT CAST(cand AS INTEGER) AS cand, round(tau, 6) AS tau, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
       round(max(accuracy) OVER (ORDER BY cand ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM sel""")
def q_model_select(spark, sf_dir):
    """J4 + D32: validation loss / accuracy of the centroid model for each temperature candidate
    (its logits scale linearly with the temperature) and the running best accuracy."""
    from pyspark.sql import Window as _W
    pr = prepared(spark, sf_dir, "emb")
    val = pr.std_cells.join(P.split_ids(pr.split, "val"), "noun_id", "left_semi")
    zv = M.logits(val, pr.W, pr.B)
    cand = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(_TAUS))]).alias("cand"),
                                  F.array(*[F.lit(v) for v in _TAUS]).alias("tau")))
    zt = zv.select("noun_id", "class_idx", "z", cand.alias("c")).select(
        F.col("c.cand").alias("cand"), F.col("c.tau").alias("tau"), "noun_id", "class_idx",
        (F.col("z") * F.col("c.tau") / M.TEMPERATURE).alias("z"))
    pt = M.softmax(zt, keys=("cand", "noun_id"))
    lab = pr.labelled.select("noun_id", F.col("class_idx").alias("label"))
    pred = M.argmax_class(pt, keys=("cand", "noun_id"))
    ev = pt.join(lab, "noun_id").where(F.col("class_idx") == F.col("label")).join(pred, ["cand", "noun_id"]).select(
        "cand", "tau", "noun_id", F.col("p").alias("pl"), (F.col("pred") == F.col("label")).alias("ok"))
    sel = ev.groupBy("cand", "tau").agg(F.avg(-F.log("pl")).alias("loss"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    best = F.max("accuracy").over(_W.orderBy("cand").rowsBetween(_W.unboundedPreceding, 0))  # candidates: bounded list
    return sel.select(F.col("cand").cast("int").alias("cand"), r6("tau").alias("tau"), r6("loss").alias("loss"),
                      r6("accuracy").alias("accuracy"), r6(best).alias("best_so_far"))


# ---- A5 / A6 / A2 / A3 / A10 / A11 / A14: files ------------------------------------------------------------

import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from chronoscope.session import checkpoint_dir  # noqa: E402
from chronoscope.sources import text_formats as TX  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a machine-local path)."""
    return _os.path.join(checkpoint_dir(spark), f"{name}-{_uuid.uuid4().hex}")


_TEXT_ORACLE = O.prelude("evt") + """,
ids AS (SELECT noun_id, row_number() OVER (ORDER BY noun_id) - 1 AS idx FROM (SELECT DISTINCT noun_id FROM cells))
SELECT CAST(i.idx AS BIGINT) AS noun_id, c.feature, c.t, round(c.x, 6) AS x, t.target
FROM cells c JOIN ids i ON i.noun_id = c.noun_id JOIN targets t ON t.noun_id = c.noun_id"""


@register("read_arff_text", _TEXT_ORACLE)
def q_read_arff_text(spark, sf_dir):
    """A5: the events signals written as relational ARFF text, read back by the text job."""
    pr = prepared(spark, sf_dir, "evt")
    path = _scratch(spark, "arff")
    TX.write_arff_relational(pr.cells, pr.targets, path)
    return TX.read_arff_relational(spark, path).select("noun_id", "feature", "t", r6("x").alias("x"), "target")


@register("read_ts_text", _TEXT_ORACLE)
def q_read_ts_text(spark, sf_dir):
    """The same signals as .ts text."""
    pr = prepared(spark, sf_dir, "evt")
    path = _scratch(spark, "ts")
    TX.write_ts(pr.cells, pr.targets, path)
    return TX.read_ts(spark, path).select("noun_id", "feature", "t", r6("x").alias("x"), "target")


@register("results_roundtrip", O.sweep_prelude(_IG) + """
SELECT method, mask, round(k, 6) AS k, noun_id, round(metric_score, 6) AS metric_score, round(mean_tic, 6) AS mean_tic FROM resn""")
def q_results_roundtrip(spark, sf_dir):
    """A11 + A10: sweep results written as CSV in per-(method, k) folders and per-mask
    partitions, read back by glob with method, k and mask parsed from the file path."""
    res = sweep_results(prepared(spark, sf_dir, "emb"), tuple(_IG))
    root = _scratch(spark, "results")
    run = F.concat(F.lit("interpretability_"), F.col("method"), F.lit("__"), F.format_number("k", 2))
    (res.select(run.alias("run"), "mask", "noun_id", "metric_score", "mean_tic")
        .write.mode("overwrite").partitionBy("run", "mask").option("header", True).csv(root))
    back = TX.read_results_by_path(spark, root)
    return back.select("method", "mask", r6("k").alias("k"), F.col("noun_id").cast("bigint").alias("noun_id"),
                       r6(F.col("metric_score").cast("double")).alias("metric_score"),
                       r6(F.col("mean_tic").cast("double")).alias("mean_tic"))


@register("write_signals", O.prelude("emb", O.SPLIT) + """
SELECT s.split, count(DISTINCT c.noun_id) AS n_samples, count(*) AS n_cells
FROM cells c JOIN split s ON s.noun_id = c.noun_id GROUP BY s.split""")
def q_write_signals(spark, sf_dir):
    """A2 + A3: one partitioned write of the signal tensors (split column, 256 MB row groups,
    uncompressed); 'total' is the folder read without a split filter, a split is a pruned read."""
    from chronoscope.sources.signals import cells_to_tensor
    pr = prepared(spark, sf_dir, "emb")
    root = _scratch(spark, "signals")
    tens = cells_to_tensor(pr.cells).join(pr.targets, "noun_id").join(pr.split, "noun_id")
    (tens.withColumn("signal_length", F.size("signal")).write.mode("overwrite")
         .option("compression", "none").option("parquet.block.size", 256 << 20).partitionBy("split").parquet(root))
    back = spark.read.parquet(root)
    cells = back.select("split", "noun_id", F.explode("signal").alias("_row")).select("split", "noun_id", F.explode("_row").alias("x"))
    return cells.groupBy("split").agg(F.count_distinct("noun_id").alias("n_samples"), F.count(F.lit(1)).alias("n_cells"))


@register("dataset_stats")
def q_dataset_stats(spark, sf_dir):
    """Rows and bytes of a Parquet dataset (bytes = sum of distinct file sizes) with the
    reference's three sanity checks as a flag column."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("_metadata.file_path").alias("f"),
                                                                     F.col("_metadata.file_size").alias("sz"))
    per_file = df.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.first("sz").alias("sz"))
    st = per_file.agg(F.sum("n").alias("n_rows"), F.sum("sz").alias("total_bytes"), F.count(F.lit(1)).alias("n_files"))
    ok = (F.col("n_rows") > 0) & (F.col("total_bytes") > 0) & (F.col("n_rows") <= F.col("total_bytes"))
    return st.withColumn("valid", ok)


# ---- L1: streaming feature statistics -------------------------------------------------------------------------

from chronoscope.streaming import feature_stats as ST  # noqa: E402


@register("streaming_feature_stats", """
SELECT event_type AS feature, count(value) AS n, round(avg(value), 6) AS mean,
       round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END, 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type""")
def q_streaming_feature_stats(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = ST.streaming_feature_stats(spark, path, schema, "event_type", "value")
    return out.select("feature", "n", *[r6(c).alias(c) for c in ["mean", "std", "min", "max"]])


@register("streaming_window_stats", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS feature, count(value) AS n, round(avg(value), 6) AS mean,
       round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END, 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY 1, 2""")
def q_streaming_window_stats(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = ST.windowed_feature_stats(spark, path, schema, "ts", "event_type", "value")
    return out.select("window_start", "feature", "n", *[r6(c).alias(c) for c in ["mean", "std", "min", "max"]])


# ---- I11 / I12 / J1b / J1c / J14 / J15: order-dependent and model-fitting operators (rows-only checks) ----------

from chronoscope.operators import surrogate as SG  # noqa: E402


_EVT_REC = _EVT.replace("WITH", "WITH RECURSIVE", 1)


@register("block_shuffle", _EVT_REC + "," + O.shuffle_walk("walk", "cells", "0.1") + "\n" + _OUT + O.shuffled("walk", "cells"))
def q_block_shuffle(spark, sf_dir):
    """I11; in the SQL the blocks compound by recursion over the steps."""
    return _cells_out(AG.block_shuffle(_evt_cells(spark, sf_dir)))


def _rand_augment_query(epoch):
    def q(spark, sf_dir):
        """I12 at magnitude 3: the op and its magnitude are drawn per call from md5(seed, epoch), in the SQL too."""
        return _cells_out(AG.rand_augment(_evt_cells(spark, sf_dir), epoch))
    return q


# random block, permute block, scaling, jitter, drop block; block shuffle, flip, window slice and identity
for _name, _epoch in (("rand_augment", 22), ("rand_augment_17", 17), ("rand_augment_21", 21), ("rand_augment_27", 27), ("rand_augment_28", 28),
                      ("rand_augment_33", 33), ("rand_augment_26", 26), ("rand_augment_18", 18), ("rand_augment_24", 24)):
    register(_name, _EVT_REC + "," + O.augment_stage("cells", "aug", _epoch) + "\n" + _OUT + "aug")(_rand_augment_query(_epoch))

_TWO_OPS = ("Shuffle_block", "Flip_Y", "Scaling")


@register("rand_augment_two", _EVT_REC + "," + O.augment_stage("cells", "one", 19, 0, _TWO_OPS) + "," + O.augment_stage("one", "two", 19, 1, _TWO_OPS) + "\n" + _OUT + "two")
def q_rand_augment_two(spark, sf_dir):
    """Two operations after each other, out of three."""
    return _cells_out(AG.rand_augment(_evt_cells(spark, sf_dir), 19, ops=_TWO_OPS, n_ops=2))


def _default_run(spark, sf_dir):
    from chronoscope.plans.pipeline import DEFAULT_METHODS
    pr = prepared(spark, sf_dir, "emb")
    if "_summary_default" not in pr.__dict__:
        pr.__dict__["_summary_default"] = materialize(S.summary(sweep_results(pr, DEFAULT_METHODS)))
    return pr.__dict__["_summary_default"], sweep_results(pr, DEFAULT_METHODS)


@register("summary_default_methods")
def q_summary_default(spark, sf_dir):
    """K4 over all six methods of the default evaluation (KernelSHAP has no SQL form)."""
    return _default_run(spark, sf_dir)[0].select("method", "mask", *[r6(c).alias(c) for c in _SUM_DOUBLES])


@register("xpower_default_methods")
def q_xpower_default(spark, sf_dir):
    """K7 over all six methods of the default evaluation."""
    return S.xpower(*_default_run(spark, sf_dir)).select("method", *[r6(c).alias(c) for c in ["diff_auc", "aucskew", "auckurt", "xpower_raw", "xpower"]])


@register("logistic_fit_score")
def q_logistic(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return SG.fit_score_ml(pr.std_cells, pr.labelled, pr.train_ids, pr.test_ids, "logistic")


@register("mlp_fit_score")
def q_mlp(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return SG.fit_score_ml(pr.std_cells, pr.labelled, pr.train_ids, pr.test_ids, "mlp")


def _surrogate_q(kind):
    def q(spark, sf_dir):
        pr = prepared(spark, sf_dir, "emb")
        st, brand, _ = _state(pr)
        fn = SG.kernelshap if kind == "kernelshap" else SG.lime
        return fn(pr.test_cells, pr.W, pr.B, st, brand).select("noun_id", "feature", "t", r6("r").alias("r"))
    return q


register("attr_kernelshap")(_surrogate_q("kernelshap"))
register("attr_lime")(_surrogate_q("lime"))


# ---- J20 / J2: a network with a hidden layer (training has no SQL form: rows-only, tests in test_network) ---------

from chronoscope.operators import network as N  # noqa: E402
from chronoscope.plans.pipeline import DEFAULT_METHODS, expected_value  # noqa: E402


@register("attr_perceptron")
def q_attr_perceptron(spark, sf_dir):
    """Every method of the contract on a perceptron, with the method's own kind of baseline."""
    pr = prepared(spark, sf_dir, "emb", "perceptron")
    rows = [relevance(pr, m).select(F.lit(m).alias("method"), "noun_id", "feature", "t", r6("r").alias("r")) for m in N.RULES]
    return reduce(DataFrame.unionByName, rows)


@register("perceptron_sweep")
def q_perceptron_sweep(spark, sf_dir):
    """K3 for the perceptron, all default methods."""
    return _result_select(sweep_results(prepared(spark, sf_dir, "emb", "perceptron"), DEFAULT_METHODS))


def _completeness(pr, methods):
    state = _state(pr)[0]
    rows = [N.completeness(relevance(pr, m), state, expected_value(pr, m)).select(F.lit(m).alias("method"), "noun_id", r6("sum_r").alias("sum_r"), r6("delta_p").alias("delta_p"), "complete") for m in methods]
    return reduce(DataFrame.unionByName, rows)


@register("completeness_all", O.sweep_prelude(_ALL) + """
SELECT r.method, r.noun_id, round(sum(r.r), 6) AS sum_r, round(max(s.s1) - max(e.expected_value), 6) AS delta_p, abs(sum(r.r) - (max(s.s1) - max(e.expected_value))) <= 1e-6 AS complete
FROM rel r JOIN score1 s ON s.noun_id = r.noun_id JOIN expv e ON e.method = r.method AND e.noun_id = r.noun_id GROUP BY r.method, r.noun_id""")
def q_completeness_all(spark, sf_dir):
    """J19 for all methods with a baseline, flagged."""
    return _completeness(prepared(spark, sf_dir, "emb"), _ALL)


@register("completeness_perceptron")
def q_completeness_perceptron(spark, sf_dir):
    return _completeness(prepared(spark, sf_dir, "emb", "perceptron"), DEFAULT_METHODS)


# ---- C11 / C12: entity-aligned combination -------------------------------------------------------------------

_ENT_SQL = """
WITH li AS (SELECT CAST(l_suppkey AS BIGINT) AS noun_id, l_returnflag AS flag,
                   (year(l_shipdate) * 12 + month(l_shipdate) - 1)
                     - (SELECT min(year(l_shipdate) * 12 + month(l_shipdate) - 1) FROM lineitem) AS step,
                   coalesce(l_quantity, 0.0) AS q FROM lineitem),
b AS (SELECT noun_id, flag, step, sum(q) AS q, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY 1, 2, 3),
flags AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS entity FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem)),
dims AS (SELECT (SELECT max(step) + 1 FROM b) AS nT),
grid AS (SELECT noun_id, e.entity, f.feature, unnest(range(nT)) AS t
         FROM (SELECT DISTINCT noun_id FROM b), flags e, (SELECT unnest([0, 1]) AS feature) f, dims),
ent AS (SELECT g.noun_id, CAST(g.entity AS BIGINT) AS entity, CAST(g.feature AS BIGINT) AS feature, CAST(g.t AS BIGINT) AS t,
               coalesce(CASE WHEN g.feature = 0 THEN b.q ELSE b.n END, 0.0) AS x
        FROM grid g JOIN flags fl ON fl.entity = g.entity
        LEFT JOIN b ON b.noun_id = g.noun_id AND b.flag = fl.flag AND b.step = g.t)
"""


@register("combine_by_entity", _ENT_SQL + """
SELECT noun_id, CAST(entity * 2 + feature AS BIGINT) AS feature, t, round(x, 6) AS x, true AS shape_ok FROM ent""")
def q_combine_by_entity(spark, sf_dir):
    from chronoscope.sources.signals import entity_cells_from_lineitem
    out = P.combine_entities(entity_cells_from_lineitem(spark, sf_dir), "entity")
    return out.select("noun_id", "feature", "t", r6("x").alias("x"), "shape_ok")


@register("combine_by_feature", _ENT_SQL + """,
ne AS (SELECT count(*) AS nE FROM flags)
SELECT noun_id, CAST(feature * nE + entity AS BIGINT) AS feature, t, round(x, 6) AS x, true AS shape_ok FROM ent, ne""")
def q_combine_by_feature(spark, sf_dir):
    from chronoscope.sources.signals import entity_cells_from_lineitem
    out = P.combine_entities(entity_cells_from_lineitem(spark, sf_dir), "feature")
    return out.select("noun_id", "feature", "t", r6("x").alias("x"), "shape_ok")


# ---- A9 / A13: class table and state tables as files ----------------------------------------------------------

@register("write_class_table", O.prelude("evt") + "\nSELECT noun_id, target FROM targets")
def q_write_class_table(spark, sf_dir):
    """(instance id, class) CSV written and read back (labels stay whole strings)."""
    pr = prepared(spark, sf_dir, "evt")
    path = _scratch(spark, "classes")
    pr.targets.select("noun_id", "target").write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.schema("noun_id long, target string").option("header", True).csv(path)
    return back.select(F.col("noun_id").cast("bigint").alias("noun_id"), "target")


@register("state_roundtrip", O.prelude("evt", O.SPLIT, O.SCALER, O.ENCODER) + """
SELECT 'scaler' AS state, CAST(feature AS VARCHAR) AS key, round(mean, 6) AS v1, round(std, 6) AS v2 FROM scaler
UNION ALL SELECT 'encoder' AS state, target AS key, CAST(class_idx AS DOUBLE) AS v1, CAST(n AS DOUBLE) AS v2 FROM encoder""")
def q_state_roundtrip(spark, sf_dir):
    """Fitted scaler and encoder saved as Parquet tables and loaded back for use."""
    pr = prepared(spark, sf_dir, "evt")
    root = _scratch(spark, "state")
    pr.scaler.write.mode("overwrite").parquet(_os.path.join(root, "scaler"))
    pr.encoder.write.mode("overwrite").parquet(_os.path.join(root, "encoder"))
    sc = spark.read.parquet(_os.path.join(root, "scaler"))
    en = spark.read.parquet(_os.path.join(root, "encoder"))
    a = sc.select(F.lit("scaler").alias("state"), F.col("feature").cast("string").alias("key"), r6("mean").alias("v1"), r6("std").alias("v2"))
    b = en.select(F.lit("encoder").alias("state"), F.col("target").alias("key"), F.col("class_idx").cast("double").alias("v1"),
                  F.col("n").cast("double").alias("v2"))
    return a.unionByName(b)


# ---- J2 / M3 / M5 (Arrow-batch scoring) and F4 (shape probe) ------------------------------------------------

@register("score_batches_pandas", _MODEL_PRE + "\nSELECT noun_id, class_idx, round(z, 6) AS z, round(p, 6) AS p FROM p1")
def q_score_batches_pandas(spark, sf_dir):
    pr = prepared(spark, sf_dir, "emb")
    return M.scores_in_batches(pr.test_cells, pr.W, pr.B).select("noun_id", "class_idx", r6("z").alias("z"), r6("p").alias("p"))


@register("shape_probe", O.prelude("sup") + """
SELECT max(t) + 1 AS n_steps, count(DISTINCT feature) AS n_feat FROM cells WHERE noun_id = (SELECT min(noun_id) FROM cells)""")
def q_shape_probe(spark, sf_dir):
    """(steps, features) of the signals read from one sample's tensor (all samples share it)."""
    from chronoscope.sources.signals import cells_to_tensor
    cells = prepared(spark, sf_dir, "sup").cells
    first = cells.select(F.min("noun_id")).scalar()  # the id first: one tensor is built
    tens = cells_to_tensor(cells.where(F.col("noun_id") == first))
    return tens.select(F.size("signal").cast("bigint").alias("n_steps"), F.size(F.col("signal")[0]).cast("bigint").alias("n_feat"))


# ---- K2 / K3 on a multivariate signal set (5 channels x 30 days, 2 classes) -----------------------------------

@register("corruption_sweep_evt", O.sweep_prelude(_ALL, "evt") + "\n" + _result_select_sql("resn"))
def q_corruption_sweep_evt(spark, sf_dir):
    return _result_select(sweep_results(prepared(spark, sf_dir, "evt"), tuple(_ALL)))


@register("summary_evt", O.sweep_prelude(_ALL, "evt", O.SUMMARY)
          + "\nSELECT method, mask, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUM_DOUBLES) + " FROM summ")
def q_summary_evt(spark, sf_dir):
    return S.summary(sweep_results(prepared(spark, sf_dir, "evt"), tuple(_ALL))).select("method", "mask", *[r6(c).alias(c) for c in _SUM_DOUBLES])


# ---- all six default methods with an oracle: ten cells a sample, so KernelSHAP has every coalition --------------

_SIX = list(DEFAULT_METHODS)


def _totals_run(spark, sf_dir):
    return sweep_results(prepared(spark, sf_dir, "tot"), DEFAULT_METHODS)


@register("attr_kernelshap_totals", O.rel_prelude("kernelshap", "tot") + "\nSELECT noun_id, feature, t, round(r, 6) AS r FROM rel")
def q_kernelshap_totals(spark, sf_dir):
    """J14 on signals of ten cells: the exact Shapley values."""
    return relevance(prepared(spark, sf_dir, "tot"), "kernelshap").select("noun_id", "feature", "t", r6("r").alias("r"))


@register("corruption_sweep_totals", O.sweep_prelude(_SIX, "tot") + "\n" + _result_select_sql("resn"))
def q_corruption_sweep_totals(spark, sf_dir):
    return _result_select(_totals_run(spark, sf_dir))


@register("summary_totals", O.sweep_prelude(_SIX, "tot", O.SUMMARY) + "\nSELECT method, mask, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUM_DOUBLES) + " FROM summ")
def q_summary_totals(spark, sf_dir):
    return S.summary(_totals_run(spark, sf_dir)).select("method", "mask", *[r6(c).alias(c) for c in _SUM_DOUBLES])


@register("method_metrics_totals", O.sweep_prelude(_SIX, "tot", O.SUMMARY, O.METRICS) + "\nSELECT method, round(AUCSE_top, 6) AS AUCSE_top, round(F_score, 6) AS F_score FROM mmetrics")
def q_method_metrics_totals(spark, sf_dir):
    return S.method_metrics(S.summary(_totals_run(spark, sf_dir))).select("method", r6("AUCSE_top").alias("AUCSE_top"), r6("F_score").alias("F_score"))


# ---- A1 / A12 / A15 / J4: stored signals, id lists, prediction table, model selection -------------------------

_SPAN_SQL = """
, span AS (SELECT noun_id, min(step) AS d0, max(step) AS d1, max(step) - min(step) + 1 AS len FROM binned GROUP BY noun_id),
least AS (SELECT CAST(floor(quantile_cont(len, 0.25)) AS BIGINT) AS n FROM span)"""


@register("read_signals", O.prelude("evt") + _SPAN_SQL + """
SELECT noun_id, CAST(len AS INTEGER) AS signal_length, e.e AS epoch FROM span, least, (SELECT unnest([0, 1, 2]) AS e) e WHERE len >= least.n""")
def q_read_signals(spark, sf_dir):
    """A1: two fields of the stored signals that are long enough (B2, B11), for three epochs."""
    root = _scratch(spark, "signals")
    SG_SRC.rows_from_events(spark, sf_dir).withColumn("signal_length", F.size("signal")).write.mode("overwrite").parquet(root)
    least = spark.read.parquet(root).select(P.min_length_quantile_of("signal_length", 0.75)).first()[0]
    return SG_SRC.read_signals(spark, root, ["noun_id", "signal_length"], F.col("signal_length") >= least, epochs=3)


@register("point_lookup", O.prelude("emb", O.SPLIT) + f""",
one AS (SELECT noun_id FROM targets ORDER BY {O.key60_sql("'lookup'", 'noun_id')}, noun_id LIMIT 1)
SELECT c.noun_id, c.feature, c.t, round(c.x, 6) AS x, t.target FROM cells c JOIN targets t ON t.noun_id = c.noun_id WHERE c.noun_id IN (SELECT noun_id FROM one)""")
def q_point_lookup(spark, sf_dir):
    """One sample (the first in md5 order) out of the stored signals, by its bucket."""
    pr = prepared(spark, sf_dir, "emb")
    if "_stored_rows" not in pr.__dict__:
        pr.__dict__["_stored_rows"] = SG_SRC.store_for_lookup(SG_SRC.rows_from_embeddings(spark, sf_dir))
    one = pr.targets.select("noun_id", sort_key60(P.SEED, F.lit("lookup"), "noun_id").alias("_h")).orderBy("_h", "noun_id").first()["noun_id"]
    found = SG_SRC.point_lookup(pr.__dict__["_stored_rows"], one)
    return SG_SRC.tensor_to_cells(found).join(found.select("noun_id", F.get("labels", F.lit(0)).alias("target")), "noun_id").select("noun_id", "feature", "t", r6("x").alias("x"), "target")


@register("id_lists", O.prelude("emb", O.SPLIT) + "\nSELECT noun_id, split FROM split")
def q_id_lists(spark, sf_dir):
    """Split ids written as lists and read back one by one."""
    from chronoscope.sources.signals import read_id_list, write_id_lists
    root = _scratch(spark, "ids")
    write_id_lists(prepared(spark, sf_dir, "emb").split, root)
    return reduce(DataFrame.unionByName, [read_id_list(spark, root, n).withColumn("split", F.lit(n)) for n in P.SPLIT_NAMES])


@register("split_two_way", O.prelude("emb", O.SPLIT) + f""",
rest AS (SELECT noun_id, row_number() OVER (ORDER BY {O.key60_sql('noun_id')}, noun_id) AS rnk, count(*) OVER () AS n FROM split WHERE split <> 'test')
SELECT noun_id, CASE WHEN rnk <= ceil(CAST(0.85 AS DOUBLE) * n) THEN 'train' ELSE 'val' END AS split FROM rest
UNION ALL SELECT noun_id, 'test' AS split FROM test_ids""")
def q_split_two_way(spark, sf_dir):
    """An archive with its own test part: the other samples in two slices, the test part kept."""
    pr = prepared(spark, sf_dir, "emb")
    return P.split_keeping_test(pr.split.where(F.col("split") != "test"), pr.test_ids)


@register("prediction_table", _MODEL_PRE + """
SELECT s.noun_id, any_value(l.class_idx) AS label, any_value(s.pred) AS pred, """ + ", ".join(
    f"round(max(CASE WHEN p.class_idx = {c} THEN p.p END), 6) AS score_{c}" for c in range(10)) + """
FROM score1 s JOIN labelled l ON s.noun_id = l.noun_id JOIN p1 p ON p.noun_id = s.noun_id GROUP BY s.noun_id""")
def q_prediction_table(spark, sf_dir):
    """One score column per class, written and read back."""
    pr = prepared(spark, sf_dir, "emb")
    root = _scratch(spark, "predictions")
    classes = range(pr.encoder.count())  # one row per class
    M.prediction_table(pr.p1, pr.labelled, len(classes)).write.mode("overwrite").parquet(root)
    return spark.read.parquet(root).select("noun_id", "label", "pred", *[r6(f"score_{c}").alias(f"score_{c}") for c in classes])


@register("model_select_ml")
def q_model_select_ml(spark, sf_dir):
    """J4 by ml.tuning: a cross-validated grid, the best model stored, loaded again and scored on the test
    split (rows-only: the optimiser has no SQL form)."""
    from chronoscope.operators import surrogate
    pr = prepared(spark, sf_dir, "emb")
    fitted = pr.split.where(F.col("split") != "test").select("noun_id")
    out = surrogate.select_classifier(pr.std_cells, pr.labelled, fitted, pr.test_ids, _scratch(spark, "model"))
    return out.select("cand", "regParam", "elasticNetParam", r6("val_accuracy").alias("val_accuracy"), r6("best_so_far").alias("best_so_far"), "chosen", r6("test_accuracy").alias("test_accuracy"))


_SHRINK = [0.05, 0.2, 0.5, 0.8, 1.0, 1.5]


def _shrink_eval_sql(split: str, name: str) -> str:
    return f"""
a_{name} AS (SELECT c.noun_id, f.class_idx, sum((c.x - f.g) * f.delta) AS a, sum(f.delta * f.delta) AS d, count(*) AS k
  FROM std_cells c JOIN fitted f ON f.feature = c.feature AND f.t = c.t
  WHERE c.noun_id IN (SELECT noun_id FROM split WHERE split = '{split}') GROUP BY 1, 2),
z_{name} AS (SELECT v.cand, v.shrink, a.noun_id, a.class_idx, {O.TAU!r} / a.k * (2.0 * v.shrink * a.a - v.shrink * v.shrink * a.d) AS z FROM a_{name} a, shr v),
c_{name} AS (SELECT *, z - max(z) OVER (PARTITION BY cand, noun_id) AS zc FROM z_{name}),
p_{name} AS (SELECT *, exp(zc) / sum(exp(zc)) OVER (PARTITION BY cand, noun_id) AS p FROM c_{name}),
e_{name} AS (SELECT p.cand, p.shrink, p.noun_id, max(CASE WHEN p.class_idx = l.class_idx THEN p.p END) AS pl,
    first(p.class_idx ORDER BY p.p DESC, p.class_idx) = max(l.class_idx) AS ok
  FROM p_{name} p JOIN labelled l ON l.noun_id = p.noun_id GROUP BY 1, 2, 3),
s_{name} AS (SELECT cand, shrink, avg(-ln(pl)) AS loss, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS accuracy FROM e_{name} GROUP BY 1, 2)"""


@register("model_select_shrinkage", O.prelude("emb", O.SPLIT, O.SCALER, O.ENCODER) + f""",
shr AS (SELECT * FROM (VALUES {", ".join(f"({i}, {v!r})" for i, v in enumerate(_SHRINK))}) v(cand, shrink)),
tr AS (SELECT l.class_idx, c.feature, c.t, sum(c.x) AS sx, count(*) AS n FROM std_cells c JOIN labelled l ON l.noun_id = c.noun_id
       WHERE c.noun_id IN (SELECT noun_id FROM train_ids) GROUP BY 1, 2, 3),
fitted AS (SELECT class_idx, feature, t, sum(sx) OVER w / sum(n) OVER w AS g, sx / n - sum(sx) OVER w / sum(n) OVER w AS delta
           FROM tr WINDOW w AS (PARTITION BY feature, t)),""" + _shrink_eval_sql("val", "v") + "," + _shrink_eval_sql("test", "t") + """,
pick AS (SELECT cand FROM s_v ORDER BY accuracy DESC, loss, cand LIMIT 1)
SELECT CAST(v.cand AS INTEGER) AS cand, round(v.shrink, 6) AS shrink, round(v.loss, 6) AS val_loss, round(v.accuracy, 6) AS val_accuracy,
       round(max(v.accuracy) OVER (ORDER BY v.cand ROWS UNBOUNDED PRECEDING), 6) AS best_so_far, v.cand = (SELECT cand FROM pick) AS chosen,
       round(CASE WHEN v.cand = (SELECT cand FROM pick) THEN t.accuracy END, 6) AS test_accuracy
FROM s_v v JOIN s_t t USING (cand)""")
def q_model_select_shrinkage(spark, sf_dir):
    """J4 with candidates that change the decisions: centroids shrunk to the common mean; the best on the
    validation split is restored and scores the test split."""
    pr = prepared(spark, sf_dir, "emb")
    val, test = (pr.std_cells.join(P.split_ids(pr.split, n), "noun_id", "left_semi") for n in ("val", "test"))
    out = M.select_model(val, test, pr.labelled, materialize(M.fit_shrinkable(pr.std_cells, pr.labelled, pr.train_ids)), _SHRINK)
    return out.select("cand", *[r6(c).alias(c) for c in ("shrink", "val_loss", "val_accuracy", "best_so_far", "test_accuracy")], "chosen")
