"""Surrogate-model attributions (J14 KernelSHAP, J15 LIME) and Spark ML classifiers.

KernelSHAP and LIME fit a weighted linear model per sample on perturbed copies of it (`fitted_values`, run
over batches of samples by `network.attribute`). The coalitions depend on the seed and the number of cells D
alone: all samples share them, and the number of draws grows with D, so the fit never has fewer draws than
unknowns. They are kept as one byte a cell and worked on in blocks.

KernelSHAP draws coalition sizes evenly and coalitions evenly within a size, in complementary pairs. The
draw carries the factor 1 / C(D, k) of the Shapley kernel already, so the weight left is
(D - 1) / (k (D - k)). Empty and full coalition hold exactly: the values of one cell are eliminated by
sum(phi) = p(x) - p(b). If all 2^D - 2 coalitions are no more than the draws they are enumerated, with
the full kernel weight, and the values are the exact Shapley values.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
LEAST_DRAWS = 1024
DRAWS_PER_CELL = 16
LIME_KERNEL_WIDTH = 1.0
LIME_RIDGE = 0.01
HIDDEN = 8
BLOCK_CELLS = 1 << 22


def coalitions(n_cells: int, n_draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks of 0 and 1, kernel weights) for KernelSHAP."""
    d = n_cells
    if d <= 20 and 2 ** d - 2 <= n_draws:
        masks = ((np.arange(1, 2 ** d - 1)[:, None] >> np.arange(d)) & 1).astype(float)
        k = masks.sum(axis=1)
        return masks, np.array([(d - 1) / (comb(d, int(x)) * x * (d - x)) for x in k])
    rng = np.random.default_rng(seed)
    size = rng.integers(1, d, n_draws // 2)
    order = rng.random((n_draws // 2, d)).argsort(axis=1).argsort(axis=1)
    half = (order < size[:, None]).astype(float)
    masks = np.concatenate([half, 1 - half])
    k = masks.sum(axis=1)
    return masks, (d - 1) / (k * (d - k))


def kernel_values(masks: np.ndarray, weights: np.ndarray, y: np.ndarray, v0: float, v1: float) -> np.ndarray:
    """Weighted least squares under sum(phi) = v1 - v0, from the coalition values y."""
    total = v1 - v0
    if masks.shape[1] == 1:
        return np.array([total])
    a = masks[:, :-1] - masks[:, -1:]
    b = y - v0 - masks[:, -1] * total
    aw = a * weights[:, None]
    phi = np.linalg.lstsq(aw.T @ a, aw.T @ b, rcond=None)[0]
    return np.append(phi, total - phi.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


_SHARED: dict = {}  # coalitions and what depends on them alone, made once per worker


def shared_coalitions(n_cells: int, n_draws: int, seed: int, kind: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(masks of one byte a cell, kernel weights, inverse of the normal matrix): all samples share them, so
    the dense solve of KernelSHAP is done once. The normal matrix is summed over blocks of coalitions."""
    key = (n_cells, n_draws, seed, kind)
    if key not in _SHARED:
        _SHARED.clear()
        if kind == "lime":
            _SHARED[key] = ((np.random.default_rng(seed).random((n_draws, n_cells)) < 0.5), None, None)
        elif n_cells == 1:
            _SHARED[key] = (np.zeros((0, 1), bool), np.zeros(0), None)
        else:
            masks, weights = coalitions(n_cells, n_draws, seed)
            masks = masks.astype(bool)
            normal = np.zeros((n_cells - 1, n_cells - 1))
            for at in blocks(masks):
                a = masks[at, :-1].astype(float) - masks[at, -1:]
                normal += (a * weights[at, None]).T @ a
            _SHARED[key] = (masks, weights, np.linalg.pinv(normal, hermitian=True))
    return _SHARED[key]


def blocks(masks: np.ndarray):
    step = max(1, BLOCK_CELLS // max(1, masks.shape[1]))
    return [slice(i, i + step) for i in range(0, len(masks), step)]


def fitted_values(net, x: np.ndarray, xb: np.ndarray, target: int, kind: str, n_samples: int | None, seed: int) -> np.ndarray:
    """The coefficients of the weighted linear fit for one sample and baseline. A coalition keeps the cells
    of x where its mask is set and those of xb elsewhere; only the first layer's sums of it are formed."""
    d = len(x)
    masks, weights, inverse = shared_coalitions(d, n_samples or max(LEAST_DRAWS, DRAWS_PER_CELL * d), seed, kind)
    w, b = net.layers[0]
    own, rest = w * (x - xb), w @ xb + b

    def values(m):
        first = m @ own.T + rest
        return softmax(net.onward(first, first)[1][-1])[:, target]

    if kind == "kernelshap":
        v0, v1 = values(np.array([np.zeros(d), np.ones(d)]))
        if d == 1:
            return np.array([v1 - v0])
        right = np.zeros(d - 1)
        for at in blocks(masks):
            m = masks[at].astype(float)
            right += ((m[:, :-1] - m[:, -1:]) * weights[at, None]).T @ (values(m) - v0 - m[:, -1] * (v1 - v0))
        phi = inverse @ right
        return np.append(phi, v1 - v0 - phi.sum())
    # LIME: kernel of the cosine distance to x, ridge regression with an intercept
    normal, right = LIME_RIDGE * np.eye(d + 1), np.zeros(d + 1)
    size = np.linalg.norm(x)
    for at in blocks(masks):
        m = masks[at].astype(float)
        norm = np.sqrt(np.maximum(xb @ xb + m @ (x * x - xb * xb), 0.0))
        cos = (xb @ x + m @ ((x - xb) * x)) / (norm * size + 1e-12)
        a = np.hstack([np.ones((len(m), 1)), m])
        aw = a * np.exp(-((1 - cos) ** 2) / (LIME_KERNEL_WIDTH ** 2))[:, None]
        normal += aw.T @ a
        right += aw.T @ values(m)
    return np.linalg.solve(normal, right)[1:]


def kernelshap(cells, W, B, state, base, n_samples: int | None = None, seed: int = SEED) -> DataFrame:
    from chronoscope.operators.network import attribute
    return attribute("kernelshap", cells, (W, B), base, state, n_samples=n_samples, seed=seed)


def lime(cells, W, B, state, base, n_samples: int | None = None, seed: int = SEED) -> DataFrame:
    from chronoscope.operators.network import attribute
    return attribute("lime", cells, (W, B), base, state, n_samples=n_samples, seed=seed)


# --- J1b / J1c: Spark ML classifiers ------------------------------------------------------------------

def _vectors(cells: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    arr = cells.groupBy("noun_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("feature", "t", "x"))), lambda s: s["x"]).alias("_a"))
    return arr.select("noun_id", array_to_vector("_a").alias("features"))


def fit_ml(cells: DataFrame, labelled: DataFrame, train_ids: DataFrame, kind: str = "logistic"):
    """(fitted Spark ML classifier, labelled vectors of all samples)."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array
    vec = _vectors(cells).join(labelled.select("noun_id", F.col("class_idx").cast("double").alias("label")), "noun_id")
    train = vec.join(train_ids, "noun_id", "left_semi")
    if kind == "logistic":
        est = LogisticRegression(maxIter=50, regParam=0.01)
    else:
        n_in = train.select(F.size(vector_to_array("features"))).first()[0]
        n_cls = labelled.select(F.max("class_idx")).first()[0] + 1
        est = MultilayerPerceptronClassifier(layers=[n_in, HIDDEN, n_cls], maxIter=100, seed=SEED)
    return est.fit(train), vec


def fit_score_ml(cells: DataFrame, labelled: DataFrame, train_ids: DataFrame, test_ids: DataFrame, kind: str = "logistic") -> DataFrame:
    """Fit on the train split, score the test split: (noun_id, pred, p_pred)."""
    from pyspark.ml.functions import vector_to_array
    model, vec = fit_ml(cells, labelled, train_ids, kind)
    out = model.transform(vec.join(test_ids, "noun_id", "left_semi"))
    prob = vector_to_array("probability")
    return out.select("noun_id", F.col("prediction").cast("bigint").alias("pred"),
                      F.array_max(prob).alias("p_pred"), F.col("label").cast("bigint").alias("label"))


def fit_network(cells: DataFrame, labelled: DataFrame, train_ids: DataFrame):
    """A perceptron with one hidden layer, fitted on the train split, as a `Network`."""
    from chronoscope.operators.network import Network
    model, _ = fit_ml(cells, labelled, train_ids, "mlp")
    keys = sorted((r["feature"], r["t"]) for r in cells.select("feature", "t").distinct().collect())  # the model's inputs
    return Network.perceptron(model, [f for f, _ in keys], [t for _, t in keys])


# --- J4: model selection by cross-validation ---------------------------------------------------------------

N_FOLDS = 3
GRID_REG = (0.001, 0.05, 0.5)
GRID_NET = (0.0, 0.5)


def select_classifier(cells: DataFrame, labelled: DataFrame, fit_ids: DataFrame, test_ids: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """(cand, regParam, elasticNetParam, val_accuracy, best_so_far, chosen, test_accuracy): logistic models of a
    grid, judged by the mean accuracy over N_FOLDS folds. Folds are md5 draws of the id, so they do not depend
    on the partitioning. The best model, fitted on all folds, is stored at `path` (shared storage), loaded
    again and alone scores the test samples; the first of equally good candidates counts."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from chronoscope.functions.rand import uniform_int

    spark = cells.sparkSession
    vec = _vectors(cells).join(labelled.select("noun_id", F.col("class_idx").cast("double").alias("label")), "noun_id")
    fold = F.pmod(uniform_int(seed, F.lit("fold"), "noun_id"), F.lit(N_FOLDS)).cast("int")
    train = vec.join(fit_ids, "noun_id", "left_semi").withColumn("fold", fold)
    est = LogisticRegression(maxIter=30)
    grid = ParamGridBuilder().addGrid(est.regParam, GRID_REG).addGrid(est.elasticNetParam, GRID_NET).build()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    found = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=N_FOLDS, foldCol="fold", parallelism=2).fit(train)
    best = max(range(len(grid)), key=lambda i: (found.avgMetrics[i], -i))
    found.bestModel.write().overwrite().save(path)
    test = judge.evaluate(LogisticRegressionModel.load(path).transform(vec.join(test_ids, "noun_id", "left_semi")))
    rows, so_far = [], 0.0
    for i, (params, metric) in enumerate(zip(grid, found.avgMetrics)):  # one row per candidate
        so_far = max(so_far, metric)
        rows.append((i, params[est.regParam], params[est.elasticNetParam], float(metric), float(so_far), i == best, float(test) if i == best else None))
    return spark.createDataFrame(rows, "cand int, regParam double, elasticNetParam double, val_accuracy double, best_so_far double, chosen boolean, test_accuracy double")
