"""Attribution through networks of dense layers, by batches.

A `Network` is a stack of dense layers with one activation between them and a softmax at the end; with a
single layer it is the linear-softmax model. Its weights are bounded by the model, not by the data, and
travel to the Python workers as a broadcast variable. Samples come as one row each (their cells gathered by
noun_id, bounded by features x steps); every Arrow batch is worked on as one matrix, so a step of a method is
a matrix product and not a row loop, and a batch that is lost with its executor is made again from its input.

`attribute(method, cells, model, baseline, ...)` is the one contract for all methods, models and baselines.
Cells that a shorter sample lacks count as 0, and have no relevance.

  saliency              |gradient|
  integrated_gradients  Gauss-Legendre nodes between baseline and input
  deeplift(shap)        rescale rule in every layer, on mean-centred logits at the end
  gradshap              gradients at random points between drawn baselines and the input
  shapleyvalue          marginal changes along md5-ordered permutations of the cells
  kernelshap, lime      weighted linear fits over shared coalitions (see `surrogate`)
  lrp                   epsilon rule in every layer
A set of baselines is averaged over (gradshap draws from it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.operators import attribute as A
from chronoscope.operators.attribute import GRADSHAP_SAMPLES, IG_STEPS, LRP_EPS, SHAPLEY_PERMUTATIONS, gauss_legendre
from chronoscope.operators.surrogate import fitted_values, softmax

Activation = Literal["sigmoid", "tanh", "relu"]
SEED = 42
MODEL_CELLS = 20_000_000
BLOCK_CELLS = 1 << 22
#: Below this a difference of inputs is taken as none, and the derivative stands for the ratio.
FLAT = 1e-9
ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sigmoid": lambda a: 1.0 / (1.0 + np.exp(-np.clip(a, -700, 700))), "tanh": np.tanh, "relu": lambda a: np.maximum(a, 0.0)}
DERIVATIVES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sigmoid": lambda a: (s := ACTIVATIONS["sigmoid"](a)) * (1 - s), "tanh": lambda a: 1 - np.tanh(a) ** 2, "relu": lambda a: (a > 0).astype(float)}
# fixed values: the baseline that each method takes if none is named
DEFAULT_BASELINE = {"integrated_gradients": "random", "deeplift": "random", "deepliftshap": "sample", "gradshap": "sample",
                    "shapleyvalue": "random", "kernelshap": "random", "lime": "random", "saliency": None, "lrp": None}


@dataclass(frozen=True)
class Network:
    """features, steps: of the input cells, in the order of the first layer's columns (sorted). layers: pairs
    of weights (outputs x inputs) and biases."""
    features: np.ndarray
    steps: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    activation: Activation = "sigmoid"

    def __post_init__(self):
        if sum(w.size for w, _ in self.layers) > MODEL_CELLS:
            raise ValueError("the model is too large to be shipped to the workers")

    @property
    def n_cells(self) -> int:
        return len(self.features)

    def plain(self) -> tuple:
        """What a worker makes the network of again (broadcast values hold no class of this package)."""
        return self.features, self.steps, self.layers, self.activation

    @classmethod
    def linear(cls, W: DataFrame, B: DataFrame) -> Network:
        """The linear-softmax model of tables W (class_idx, feature, t, w) and B (class_idx, b)."""
        rows = W.limit(MODEL_CELLS + 1).toPandas().sort_values(["class_idx", "feature", "t"])
        bias = B.toPandas().sort_values("class_idx")["b"].to_numpy(float)
        first = rows[rows["class_idx"] == rows["class_idx"].min()]
        return cls(first["feature"].to_numpy(np.int64), first["t"].to_numpy(np.int64), ((rows["w"].to_numpy(float).reshape(len(bias), -1), bias),))

    @classmethod
    def perceptron(cls, model, features: Sequence[int], steps: Sequence[int]) -> Network:
        """A fitted MultilayerPerceptronClassificationModel: its flat weights are, layer by layer, a matrix in
        column order and the biases; hidden layers are sigmoid."""
        flat, at, layers = model.weights.toArray(), 0, []
        sizes = list(model.getLayers())
        for n_in, n_out in zip(sizes, sizes[1:]):
            layers.append((flat[at:at + n_in * n_out].reshape(n_in, n_out).T.copy(), flat[at + n_in * n_out:at + (n_in + 1) * n_out].copy()))
            at += (n_in + 1) * n_out
        return cls(np.asarray(features, np.int64), np.asarray(steps, np.int64), tuple(layers))

    # --- forward and backward, on matrices of one sample a row ---

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What enters each layer, and what each layer gives before its activation (the last: logits)."""
        return self.onward(x, x @ self.layers[0][0].T + self.layers[0][1])

    def onward(self, x: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same, where the first layer's sums are known."""
        entering, sums = [x], [first]
        for w, b in self.layers[1:]:
            entering.append(ACTIVATIONS[self.activation](sums[-1]))
            sums.append(entering[-1] @ w.T + b)
        return entering, sums

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[1][-1]

    def backward(self, m: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
        """m: multipliers of the logits; factors: of the activations before each later layer."""
        for k in range(len(self.layers) - 1, 0, -1):
            m = (m @ self.layers[k][0]) * factors[k - 1]
        return m @ self.layers[0][0]

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """d p_target / d x."""
        sums = self.forward(x)[1]
        p = softmax(sums[-1])
        own = p[np.arange(len(x)), target][:, None]
        m = -own * p
        m[np.arange(len(x)), target] += own[:, 0]
        return self.backward(m, [DERIVATIVES[self.activation](a) for a in sums[:-1]])

    def rescaled(self, x: np.ndarray, xb: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Multipliers of the rescale rule between x and the baseline xb (one row): (change of p_target) per
        change of its mean-centred logit, and the ratio of changes at every activation."""
        sums, base = self.forward(x)[1], self.forward(xb[None, :])[1]
        at = np.arange(len(x))
        dz = (sums[-1][at, target] - sums[-1].mean(axis=1)) - (base[-1][0, target] - base[-1].mean())
        dp = softmax(sums[-1])[at, target] - softmax(base[-1])[0, target]
        top = np.where(dz != 0, dp / np.where(dz != 0, dz, 1.0), 0.0)
        m = np.repeat((-top / sums[-1].shape[1])[:, None], sums[-1].shape[1], axis=1)
        m[at, target] += top
        act, slope = ACTIVATIONS[self.activation], DERIVATIVES[self.activation]
        factors = []
        for a, b in zip(sums[:-1], base[:-1]):
            da = a - b
            flat = np.abs(da) < FLAT
            factors.append(np.where(flat, slope(a), (act(a) - act(b)) / np.where(flat, 1.0, da)))
        return self.backward(m, factors)

    def layerwise(self, x: np.ndarray, target: np.ndarray, eps: float) -> np.ndarray:
        """Relevance of p_target handed down in proportion to each input's share of a sum (epsilon rule)."""
        entering, sums = self.forward(x)
        at = np.arange(len(x))
        r = np.zeros_like(sums[-1])
        r[at, target] = softmax(sums[-1])[at, target]
        for (w, _), h, a in zip(reversed(self.layers), reversed(entering), reversed(sums)):
            r = h * ((r / (a + eps * np.where(a >= 0, 1.0, -1.0))) @ w)
        return r


# --- baselines ----------------------------------------------------------------------------------------------------

def baseline_table(kind: str, cells: DataFrame, net: Network, seed: int = SEED) -> DataFrame:
    """(bid, feature, t, xb) of the named kind: zeros, random (N(0,1), one draw a cell), mean (of all samples)
    or sample (at most 50 samples)."""
    spark = cells.sparkSession
    own = spark.createDataFrame(list(zip(net.features.tolist(), net.steps.tolist())), "feature long, t long")
    if kind == "sample":
        return A.baseline_sample(cells, seed=seed)
    made = {"zeros": A.baseline_zeros, "mean": lambda _: A.baseline_mean(cells), "random": lambda keys: A.baseline_random(keys, seed)}
    if kind not in made:
        raise ValueError(f"unknown baseline {kind!r}")
    return made[kind](own).select(F.lit(0).cast("bigint").alias("bid"), "feature", "t", "xb")


def baseline_matrix(table: DataFrame, net: Network) -> np.ndarray:
    """The baselines as rows (at most 50 times the cells of the model); a cell without a value is 0."""
    if "bid" not in table.columns:
        table = table.withColumn("bid", F.lit(0))
    rows = table.select("bid", "feature", "t", "xb").limit(MODEL_CELLS + 1).toPandas()
    if len(rows) > MODEL_CELLS:
        raise ValueError("the baselines are too many to be shipped to the workers")
    bids, which = np.unique(rows["bid"].to_numpy(np.int64), return_inverse=True)
    out = np.zeros((len(bids), net.n_cells))
    out[which, positions(net, rows["feature"].to_numpy(np.int64), rows["t"].to_numpy(np.int64))] = rows["xb"].to_numpy(float)
    return out


def positions(net: Network, feature: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Columns of cells; a cell that the model does not have is an error."""
    wide = max(int(net.steps.max()), int(t.max()) if len(t) else 0) + 1
    own, asked = net.features * wide + net.steps, feature * wide + t
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], asked), len(own) - 1)
    found = order[at]
    if len(asked) and (own[found] != asked).any():
        raise ValueError("a cell that the model does not know")
    return found


# --- batches of samples -------------------------------------------------------------------------------------------

def gathered(cells: DataFrame, *keys: str) -> DataFrame:
    """(noun_id, keys..., cells): the cells (feature, t, x) of a sample as one array in order, bounded by
    features x steps."""
    return cells.groupBy("noun_id", *keys).agg(F.sort_array(F.collect_list(F.struct("feature", "t", "x"))).alias("cells"))


def _batches(net: Network, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Parts of a batch of gathered samples whose matrices are bounded: rows, matrix, row and column of every
    cell, the cells."""
    step = max(1, BLOCK_CELLS // max(1, net.n_cells))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        lists = part.column("cells")
        cells = lists.flatten()
        row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
        col = positions(net, np.asarray(cells.field("feature")), np.asarray(cells.field("t")))
        x = np.zeros((part.num_rows, net.n_cells))
        x[row, col] = np.asarray(cells.field("x"), float)
        yield part, x, row, col, cells


def states(cells: DataFrame, net: Network) -> DataFrame:
    """(noun_id, pred, s1, z_arr, p_arr) of every sample, as `attribute.sample_state`; ties in the
    prediction go to the first class."""
    shipped = cells.sparkSession.sparkContext.broadcast(net.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shipped.value)
        for batch in batches:
            for part, x, _, _, _ in _batches(net, batch):
                z = net.logits(x)
                p = softmax(z)
                pred = p.argmax(axis=1)
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("noun_id"), pa.array(pred.astype(np.int64)), pa.array(p[np.arange(len(p)), pred]), pa.array(list(z), lists), pa.array(list(p), lists)], names=["noun_id", "pred", "s1", "z_arr", "p_arr"])

    return gathered(cells).mapInArrow(run, "noun_id long, pred long, s1 double, z_arr array<double>, p_arr array<double>")


def delta_logits(changed: DataFrame, cells: DataFrame, net: Network, keys: Sequence[str]) -> DataFrame:
    """(keys..., d_arr): by how much the logits move if the cells `changed` (keys, among them noun_id, with
    feature, t and the new value x) take their new values. The sample's own cells are joined by noun_id."""
    shipped = cells.sparkSession.sparkContext.broadcast(net.plain())
    others = [k for k in keys if k != "noun_id"]
    own = gathered(cells).select("noun_id", F.col("cells").alias("own"))
    rows = gathered(changed, *others).join(own, "noun_id")
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shipped.value)
        for batch in batches:
            before = batch.drop_columns(["cells"]).rename_columns([c if c != "own" else "cells" for c in batch.schema.names if c != "cells"])
            for (part, x, _, _, _), (_, new, row, col, _) in zip(_batches(net, before), _batches(net, batch)):
                z = net.logits(x)
                x[row, col] = new[row, col]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(list(net.logits(x) - z), pa.list_(pa.float64()))], names=[*keys, "d_arr"])

    return rows.select(*keys, "cells", "own").mapInArrow(run, f"{types}, d_arr array<double>")


# --- methods: (net, x, target, baselines, ids, options) -> relevance matrix ------------------------------------------

def _gradients_along(net, x, target, bases, ids, o):
    nodes, weights = gauss_legendre(o.get("n_steps", IG_STEPS))
    r = np.zeros_like(x)
    for xb in bases:
        mean = sum(g * net.gradient(xb + a * (x - xb), target) for a, g in zip(nodes, weights))
        r += mean * (x - xb) if o.get("multiply_by_inputs", True) else mean
    return r / len(bases)


def _rescaled(net, x, target, bases, ids, o):
    r = np.zeros_like(x)
    for xb in bases:
        m = net.rescaled(x, xb, target)
        r += m * (x - xb) if o.get("multiply_by_inputs", True) else m
    return r / len(bases)


def _unit_draw(*keys) -> float:
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2.0 ** 32


def _gradients_at_draws(net, x, target, bases, ids, o):
    n, seed = o.get("n_samples", GRADSHAP_SAMPLES), o.get("seed", SEED)
    r = np.zeros_like(x)
    for s in range(n):
        xb = bases[[int(_unit_draw(seed, "gs_b", i, s) * len(bases)) for i in ids]]
        alpha = np.array([_unit_draw(seed, "gs_a", i, s) for i in ids])[:, None]
        r += net.gradient(xb + alpha * (x - xb), target) * (x - xb)
    return r / n


def _marginal_changes(net, x, target, bases, ids, o):
    """One sample at a time; the sums of the first layer grow cell by cell along a permutation."""
    n, seed, (w, b) = o.get("n_permutations", SHAPLEY_PERMUTATIONS), o.get("seed", SEED), net.layers[0]
    names = [f"{f}|{t}" for f, t in zip(net.features.tolist(), net.steps.tolist())]
    r = np.zeros_like(x)
    for k, (i, c) in enumerate(zip(ids, target)):
        for s in range(n):
            order = np.argsort([int(hashlib.md5(f"{seed}|sv|{i}|{s}|{name}".encode()).hexdigest()[:15], 16) for name in names], kind="stable")
            for xb in bases:
                steps = (w[:, order] * (x[k] - xb)[order]).T
                path = np.concatenate([np.zeros((1, len(b))), np.cumsum(steps, axis=0)]) + (w @ xb + b)
                p = softmax(net.onward(path, path)[1][-1])[:, c]
                r[k, order] += np.diff(p)
    return r / (n * len(bases))


def _fitted(net, x, target, bases, ids, o):
    r = np.zeros_like(x)
    for k, c in enumerate(target):
        for xb in bases:
            r[k] += fitted_values(net, x[k], xb, int(c), o["method"], o.get("n_samples"), o.get("seed", SEED))
    return r / len(bases)


RULES: dict[str, Callable] = {
    "saliency": lambda net, x, target, bases, ids, o: np.abs(net.gradient(x, target)),
    "lrp": lambda net, x, target, bases, ids, o: net.layerwise(x, target, o.get("eps", LRP_EPS)),
    "integrated_gradients": _gradients_along, "deeplift": _rescaled, "deepliftshap": _rescaled, "gradshap": _gradients_at_draws,
    "shapleyvalue": _marginal_changes, "kernelshap": _fitted, "lime": _fitted}
OPTIONS = {"integrated_gradients": {"n_steps", "multiply_by_inputs"}, "deeplift": {"multiply_by_inputs"}, "deepliftshap": {"multiply_by_inputs"},
           "gradshap": {"n_samples", "seed"}, "shapleyvalue": {"n_permutations", "seed"}, "kernelshap": {"n_samples", "seed"}, "lime": {"n_samples", "seed"},
           "lrp": {"eps"}, "saliency": set()}


def _baselines(method: str, cells: DataFrame, net: Network, baseline: str | DataFrame | None) -> np.ndarray:
    kind = DEFAULT_BASELINE[method] if baseline is None else baseline
    if kind is None:
        return np.zeros((1, net.n_cells))
    return baseline_matrix(baseline_table(kind, cells, net) if isinstance(kind, str) else kind, net)


def attribute(method: str, cells: DataFrame, model: Network | tuple[DataFrame, DataFrame], baseline: str | DataFrame | None = None,
              target: DataFrame | None = None, **options) -> DataFrame:
    """(noun_id, feature, t, x, r), the relevance of every cell for the probability of a class.

    cells: (noun_id, feature, t, x). model: a Network, or tables (W, B) of a linear-softmax model. baseline:
    zeros, random, mean, sample, a table (feature, t, xb) or (bid, feature, t, xb), or None for the method's
    own kind. target: (noun_id, pred), the class to explain; the predicted one if not given. An option that
    the method does not have is an error."""
    if method not in RULES:
        raise ValueError(f"unknown attribution method {method!r}")
    if unknown := set(options) - OPTIONS[method]:
        raise ValueError(f"{method} has no option {', '.join(sorted(unknown))}")
    net = model if isinstance(model, Network) else Network.linear(*model)
    shipped = cells.sparkSession.sparkContext.broadcast((net.plain(), _baselines(method, cells, net, baseline)))
    rows = gathered(cells)
    if target is not None:
        rows = rows.join(target.select("noun_id", "pred"), "noun_id")
    options = {**options, "method": method}
    asked = target is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bases = shipped.value
        net = Network(*parts)
        for batch in batches:
            for part, x, row, col, cells in _batches(net, batch):
                c = np.asarray(part.column("pred")) if asked else net.logits(x).argmax(axis=1)
                ids = part.column("noun_id")
                r = RULES[method](net, x, c, bases, ids.to_pylist(), options)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), cells.field("feature"), cells.field("t"), cells.field("x"), pa.array(r[row, col])], names=["noun_id", "feature", "t", "x", "r"])

    return rows.mapInArrow(run, "noun_id long, feature long, t long, x double, r double")


def expected_values(method: str, cells: DataFrame, net: Network, state: DataFrame, baseline: str | DataFrame | None = None) -> DataFrame:
    """(noun_id, expected_value), the mean probability of the explained class over the baselines; null
    for methods without one."""
    if DEFAULT_BASELINE[method] is None:
        return state.select("noun_id", F.lit(None).cast("double").alias("expected_value"))
    mean = softmax(net.logits(_baselines(method, cells, net, baseline))).mean(axis=0)
    return state.select("noun_id", F.get(F.lit([float(p) for p in mean]), F.col("pred").cast("int")).alias("expected_value"))


def completeness(rel: DataFrame, state: DataFrame, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(noun_id, sum_r, delta_p, complete): the sum of a sample's relevance against p(x) - p(baseline),
    and whether the two agree."""
    sums = rel.groupBy("noun_id").agg(F.sum("r").alias("sum_r"))
    j = sums.join(state.select("noun_id", "s1"), "noun_id").join(expected, "noun_id").withColumn("delta_p", F.col("s1") - F.col("expected_value"))
    return j.select("noun_id", "sum_r", "delta_p", (F.abs(F.col("sum_r") - F.col("delta_p")) <= tolerance).alias("complete"))
