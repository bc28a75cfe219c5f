"""Classifier fit and scoring as Spark jobs.

The scoring model is linear-softmax: z_c(x) = sum_j w[c, j] * x_j + b_c, p = softmax(z).
Weights live in a long table W (class_idx, feature, t, w) and biases in B (class_idx, b).
W has C*F*T rows (classes x features x steps): it is independent of the number of
samples, which is what makes broadcasting it safe; `bounded_broadcast` checks it.

Centroid model (J1a): mu[c, j] = mean of x_j over train samples of class c, and
z_c = -tau * mean_j (x_j - mu[c, j])^2 up to a per-sample constant, i.e.
w = 2 * tau * mu / D, b = -tau * sum_j mu^2 / D with D = F*T cells per sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast


TEMPERATURE = 50.0


def fit_centroid(cells: DataFrame, labelled: DataFrame, train_ids: DataFrame, tau: float = TEMPERATURE):
    """cells (noun_id, feature, t, x); labelled (noun_id, class_idx). Returns (W, B)."""
    tr = cells.join(train_ids, "noun_id", "left_semi").join(labelled.select("noun_id", "class_idx"), "noun_id")
    mu = tr.groupBy("class_idx", "feature", "t").agg(F.avg("x").alias("mu"))
    d = F.count(F.lit(1)).over(Window.partitionBy("class_idx"))  # F*T cells per class
    W = mu.select("class_idx", "feature", "t", (F.lit(2.0 * tau) * F.col("mu") / d).alias("w"), (F.col("mu") * F.col("mu") / d).alias("_m2"))
    B = W.groupBy("class_idx").agg((F.lit(-tau) * F.sum("_m2")).alias("b"))
    return W.select("class_idx", "feature", "t", "w"), B


def logits(cells: DataFrame, W: DataFrame, B: DataFrame, keys=("noun_id",), x: str = "x") -> DataFrame:
    """(keys..., class_idx, z). The join with W is broadcast; the aggregate is keyed by
    (keys, class_idx), which a noun_id partitioning already satisfies."""
    j = cells.join(bounded_broadcast(W), ["feature", "t"]).groupBy(*keys, "class_idx").agg(
        F.sum(F.col(x) * F.col("w")).alias("_zx"))
    return j.join(bounded_broadcast(B), "class_idx").select(*keys, "class_idx", (F.col("_zx") + F.col("b")).alias("z"))


def softmax(z: DataFrame, keys=("noun_id",), zcol: str = "z", out: str = "p") -> DataFrame:
    """Numerically stable softmax over class_idx within keys."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(zcol) - F.max(zcol).over(w))
    return z.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax_class(p: DataFrame, keys=("noun_id",), pcol: str = "p", out: str = "pred") -> DataFrame:
    """(keys..., out): class with the largest probability, first index on ties."""
    return p.groupBy(*keys).agg(F.min_by("class_idx", F.struct(-F.col(pcol), F.col("class_idx"))).alias(out))


def scores(cells: DataFrame, W: DataFrame, B: DataFrame) -> DataFrame:
    """(noun_id, class_idx, z, p) for every sample in `cells`."""
    return softmax(logits(cells, W, B))


def predictions(p: DataFrame, labelled: DataFrame) -> DataFrame:
    """(noun_id, label, pred, p_pred, correct) per sample (A15, D13 score1)."""
    pred = argmax_class(p)
    pp = p.join(pred, "noun_id").where(F.col("class_idx") == F.col("pred")).select("noun_id", "pred", F.col("p").alias("p_pred"))
    return pp.join(labelled.select("noun_id", F.col("class_idx").alias("label")), "noun_id").select(
        "noun_id", "label", "pred", "p_pred", (F.col("pred") == F.col("label")).alias("correct"))


def evaluate(p: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean cross-entropy and accuracy."""
    lab = labelled.select("noun_id", F.col("class_idx").alias("label"))
    ce = p.join(lab, "noun_id").where(F.col("class_idx") == F.col("label")).select("noun_id", (-F.log(F.col("p"))).alias("ce"))
    acc = predictions(p, labelled).select("noun_id", F.col("correct").cast("double").alias("ok"))
    return ce.join(acc, "noun_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ce").alias("loss"), F.avg("ok").alias("accuracy"))


def scores_in_batches(cells: DataFrame, W: DataFrame, B: DataFrame) -> DataFrame:
    """The model as a scoring function over Arrow batches, one matrix product for each.

    Each sample's cells are gathered into one row (bounded by F*T); the weights (limited by
    `network.MODEL_CELLS`) ship once as a broadcast variable. Output (noun_id, class_idx, z, p) like `scores`."""
    from chronoscope.operators.network import Network, states
    scored = states(cells, Network.linear(W, B))
    return scored.select("noun_id", F.posexplode(F.arrays_zip("z_arr", "p_arr")).alias("class_idx", "c")).select(
        "noun_id", F.col("class_idx").cast("bigint"), F.col("c.z_arr").alias("z"), F.col("c.p_arr").alias("p"))


# --- A15: prediction table with one score column per class --------------------------------------------------

def prediction_table(p: DataFrame, labelled: DataFrame, n_classes: int) -> DataFrame:
    """(noun_id, label, pred, score_0 .. score_{C-1}); null for a class without a score. One hash
    aggregate with a bounded number of columns; no pivot over unknown values."""
    columns = [F.max(F.when(F.col("class_idx") == c, F.col("p"))).alias(f"score_{c}") for c in range(n_classes)]
    return predictions(p, labelled).select("noun_id", "label", "pred").join(p.groupBy("noun_id").agg(*columns), "noun_id")


# --- J4: selection among shrunken centroid models -------------------------------------------------------------

def fit_shrinkable(cells: DataFrame, labelled: DataFrame, train_ids: DataFrame) -> DataFrame:
    """(class_idx, feature, t, g, delta): mean of all training samples, and how far each class's mean is
    from it. Shrinking by s moves the class means to g + s * delta."""
    tr = cells.join(train_ids, "noun_id", "left_semi").join(labelled.select("noun_id", "class_idx"), "noun_id")
    sums = tr.groupBy("class_idx", "feature", "t").agg(F.sum("x").alias("sx"), F.count("x").alias("n"))
    at_cell = Window.partitionBy("feature", "t")
    g = F.sum("sx").over(at_cell) / F.sum("n").over(at_cell)
    return sums.withColumn("g", g).select("class_idx", "feature", "t", "g", (F.col("sx") / F.col("n") - F.col("g")).alias("delta"))


def shrunken_logits(cells: DataFrame, fitted: DataFrame, shrinkage: list[float], tau: float = TEMPERATURE) -> DataFrame:
    """(cand, shrink, noun_id, class_idx, z) for every candidate. -|x - g - s delta|^2 is, but for a term
    that all classes share, 2 s (x - g) delta - s^2 delta^2: the sums over cells are taken once, and a
    candidate only scales them."""
    j = cells.join(bounded_broadcast(fitted), ["feature", "t"]).groupBy("noun_id", "class_idx").agg(
        F.sum((F.col("x") - F.col("g")) * F.col("delta")).alias("a"), F.sum(F.col("delta") * F.col("delta")).alias("d"), F.count(F.lit(1)).alias("k"))
    s = F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(float(v)).alias("shrink")) for i, v in enumerate(shrinkage)]))
    return j.select("noun_id", "class_idx", "a", "d", "k", s.alias("s")).select(
        "s.cand", "s.shrink", "noun_id", "class_idx",
        (F.lit(tau) / F.col("k") * (F.lit(2.0) * F.col("s.shrink") * F.col("a") - F.col("s.shrink") * F.col("s.shrink") * F.col("d"))).alias("z"))


def select_model(val: DataFrame, test: DataFrame, labelled: DataFrame, fitted: DataFrame, shrinkage: list[float]) -> DataFrame:
    """(cand, shrink, val_loss, val_accuracy, best_so_far, chosen, test_accuracy): the candidate with the
    best validation accuracy (ties: smaller loss, then first) is chosen and only it scores the test split."""
    lab = labelled.select("noun_id", F.col("class_idx").alias("label"))

    def evaluated(cells: DataFrame, candidates: list[float]) -> DataFrame:
        p = softmax(shrunken_logits(cells, fitted, candidates), keys=("cand", "noun_id"))
        pred = argmax_class(p, keys=("cand", "noun_id"))
        rows = p.join(lab, "noun_id").where(F.col("class_idx") == F.col("label")).join(pred, ["cand", "noun_id"])
        return rows.groupBy("cand", "shrink").agg(F.avg(-F.log("p")).alias("loss"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))

    tried = evaluated(val, shrinkage).collect()  # one row per candidate
    best = min(tried, key=lambda r: (-r["accuracy"], r["loss"], r["cand"]))
    restored = evaluated(test, [best["shrink"]]).select(F.lit(best["cand"]).alias("cand"), F.col("accuracy").alias("test_accuracy"))
    rows = _candidate_rows(val.sparkSession, tried)
    so_far = F.max("val_accuracy").over(Window.orderBy("cand").rowsBetween(Window.unboundedPreceding, 0))  # bounded list
    return (rows.withColumn("best_so_far", so_far).withColumn("chosen", F.col("cand") == best["cand"])
            .join(F.broadcast(restored), "cand", "left"))


def _candidate_rows(spark, tried) -> DataFrame:
    return spark.createDataFrame([(r["cand"], r["shrink"], r["loss"], r["accuracy"]) for r in tried], "cand int, shrink double, val_loss double, val_accuracy double")
