"""The evaluation pipeline as one lazily built set of DataFrames.

signal set -> split -> scaler (train) -> standardised cells -> encoder -> centroid model
-> scores of the test split. Every later stage (attribution, corruption sweep, summary)
starts from `Prepared`.

Partitioning: the test cells are hash-partitioned on noun_id once (`repartition`);
per-sample windows and aggregates downstream are keyed by (noun_id, ...) and reuse that
partitioning. Model tables are bounded by classes x features x steps and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.operators import model as M
from chronoscope.operators import network as N
from chronoscope.operators import prepare as P
from chronoscope.operators import rows as R
from chronoscope.session import materialize, materialize_bucketed
from chronoscope.sources.signals import rows_from_embeddings, signal_set, targets_by_quantile


@dataclass
class Prepared:
    spark: SparkSession
    sf_dir: str
    signal: str = "emb"
    kind: str = "centroid"  # the classifier that is explained: centroid or perceptron

    @cached_property
    def raw(self):
        cells, targets = signal_set(self.spark, self.sf_dir, self.signal)
        if self.signal == "emb":
            return cells, targets  # a plain scan of one table: nothing to reuse
        cells = materialize(cells)
        return cells, materialize(targets_by_quantile(cells))

    @property
    def cells(self) -> DataFrame:
        return self.raw[0]

    @property
    def targets(self) -> DataFrame:
        return self.raw[1]

    @cached_property
    def split(self) -> DataFrame:
        return materialize(P.assign_split(self.targets))

    @property
    def train_ids(self) -> DataFrame:
        return P.split_ids(self.split, "train")

    @property
    def test_ids(self) -> DataFrame:
        return P.split_ids(self.split, "test")

    @cached_property
    def scaler(self) -> DataFrame:
        return materialize(P.fit_scaler(self.cells, self.train_ids))

    @cached_property
    def row_transform(self) -> R.RowTransform:
        """K0: the transform of whole samples, fitted on the train split."""
        rows = rows_from_embeddings(self.spark, self.sf_dir)
        return R.fit(rows.join(self.train_ids, "noun_id", "left_semi"))

    @cached_property
    def ready(self) -> DataFrame:
        """Samples stored as one row each, prepared in that form (no join, no shuffle)."""
        return R.prepare_rows(rows_from_embeddings(self.spark, self.sf_dir), self.row_transform)

    @cached_property
    def std_cells(self) -> DataFrame:
        if self.signal == "emb":
            return R.prepared_cells(self.ready)
        return P.standardise(self.cells, self.scaler)

    @cached_property
    def encoder(self) -> DataFrame:
        return materialize(P.fit_encoder(self.targets, self.train_ids))

    @cached_property
    def labelled(self) -> DataFrame:
        if self.signal == "emb":
            return materialize(self.ready.select("noun_id", "target", F.col("encoded").alias("class_idx")))
        return materialize(P.encode_targets(self.targets, self.encoder))

    @cached_property
    def model(self):
        W, B = M.fit_centroid(self.std_cells, self.labelled, self.train_ids)
        return materialize(W), materialize(B)

    @property
    def W(self) -> DataFrame:
        return self.model[0]

    @property
    def B(self) -> DataFrame:
        return self.model[1]

    @cached_property
    def network(self) -> N.Network:
        """The classifier as a stack of layers, on the driver (bounded by its weights)."""
        if self.kind == "perceptron":
            from chronoscope.operators.surrogate import fit_network
            return fit_network(self.std_cells, self.labelled, self.train_ids)
        return N.Network.linear(self.W, self.B)

    @cached_property
    def test_cells(self) -> DataFrame:
        # bucketed by sample: later stages expand each sample (grid points x attempts x permutations)
        return materialize_bucketed(self.std_cells.join(self.test_ids, "noun_id", "left_semi"), "noun_id", "test_cells")

    @cached_property
    def p1(self) -> DataFrame:
        """(noun_id, class_idx, z, p) on the test split."""
        return materialize(M.scores(self.test_cells, self.W, self.B))

    @cached_property
    def score1(self) -> DataFrame:
        """(noun_id, pred, s1): predicted class and its probability."""
        pred = M.argmax_class(self.p1)
        return self.p1.join(pred, "noun_id").where(F.col("class_idx") == F.col("pred")).select(
            "noun_id", "pred", F.col("p").alias("s1"))


_CACHE: dict[tuple, Prepared] = {}


def prepared(spark: SparkSession, sf_dir: str, signal: str = "emb", kind: str = "centroid") -> Prepared:
    """The stages of one folder, kept for the queries of this application. Those of an application that has
    ended are dropped."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _CACHE if k[0] != application]:
        del _CACHE[key]
    key = (application, sf_dir, signal, kind)
    if key not in _CACHE:
        _CACHE[key] = Prepared(spark, sf_dir, signal, kind)
    return _CACHE[key]


# ---- attribution -------------------------------------------------------------------------------

def _state(pr: Prepared):
    from chronoscope.operators import attribute as A
    if "_state" not in pr.__dict__:
        state = N.states(pr.test_cells, pr.network) if pr.kind == "perceptron" else A.sample_state(pr.p1, pr.score1)
        pr.__dict__["_state"] = materialize_bucketed(state, "noun_id", "state")
        own = pr.W if pr.kind == "centroid" else pr.test_cells
        pr.__dict__["_base_random"] = materialize(A.baseline_random(own))
        pr.__dict__["_base_sample"] = materialize(A.baseline_sample(pr.test_cells))
    return pr.__dict__["_state"], pr.__dict__["_base_random"], pr.__dict__["_base_sample"]


def relevance(pr: Prepared, method: str) -> DataFrame:
    """(noun_id, feature, t, x, r) of the test split for one method (J18 dispatch), materialized."""
    key = ("_rel", method)
    if key not in pr.__dict__:
        pr.__dict__[key] = materialize_bucketed(_relevance(pr, method), "noun_id", f"rel_{method}")
    return pr.__dict__[key]


def _relevance(pr: Prepared, method: str) -> DataFrame:
    """The linear-softmax model has closed forms as relational plans for most methods; everything else, and
    any other model, goes by `network.attribute`."""
    from chronoscope.operators import attribute as A
    st, brand, bsamp = _state(pr)
    c = pr.test_cells
    if pr.kind == "centroid":
        W, B = pr.W, pr.B
        if method == "saliency":
            return A.saliency(c, W, B, st)
        if method == "integrated_gradients":
            return A.integrated_gradients(c, W, B, st, brand)
        if method == "deeplift":
            return A.deeplift(c, W, B, st, brand)
        if method == "deepliftshap":
            return A.deepliftshap(c, W, B, st, bsamp)
        if method == "gradshap":
            return A.gradshap(c, W, B, st, bsamp)
        if method == "lrp":
            return A.lrp(c, W, B, st)
    return N.attribute(method, c, pr.network, _baseline(pr, method), st)


def _baseline(pr: Prepared, method: str) -> DataFrame | None:
    """The stored baseline of the method's own kind."""
    _, brand, bsamp = _state(pr)
    return {"random": brand, "sample": bsamp}.get(N.DEFAULT_BASELINE[method])


def expected_value(pr: Prepared, method: str) -> DataFrame:
    from chronoscope.operators import attribute as A
    st, brand, bsamp = _state(pr)
    if pr.kind != "centroid":
        return N.expected_values(method, pr.test_cells, pr.network, st, _baseline(pr, method))
    if method in ("deepliftshap", "gradshap"):
        return A.expected_value_set(bsamp, pr.W, pr.B, st)
    if method in ("saliency", "lrp"):
        return st.select("noun_id", F.lit(None).cast("double").alias("expected_value"))
    return A.expected_value_single(brand, pr.W, pr.B, st)


# ---- corruption sweep --------------------------------------------------------------------------

# fixed values: the methods of the default evaluation; kernelshap, which has no SQL form, comes on top
SWEEP_METHODS = ("integrated_gradients", "deeplift", "deepliftshap", "gradshap", "shapleyvalue")
DEFAULT_METHODS = (*SWEEP_METHODS, "kernelshap")


def sweep_results(pr: Prepared, methods=SWEEP_METHODS) -> DataFrame:
    """K3: per (method, mask, k, noun_id) result rows with metric_normalised.
    All methods run in one plan keyed by (method, noun_id); a method's rows do not depend on the others, so
    a sweep that has been made for more methods serves for fewer."""
    from chronoscope.operators import corrupt as C
    done = pr.__dict__.setdefault("_sweeps", {})
    for made, res in done.items():
        if set(methods) <= set(made):
            return res if set(methods) == set(made) else res.where(F.col("method").isin(*methods))
    st, _, _ = _state(pr)
    rel = reduce(DataFrame.unionByName, [relevance(pr, m).select(F.lit(m).alias("method"), "*") for m in methods])
    ev = reduce(DataFrame.unionByName, [expected_value(pr, m).select(F.lit(m).alias("method"), "*") for m in methods])
    res = C.corruption_results(rel, pr.network, st, pr.labelled, pr.encoder, ev)
    done[tuple(methods)] = materialize(C.add_metric_normalised(res))
    return done[tuple(methods)]
