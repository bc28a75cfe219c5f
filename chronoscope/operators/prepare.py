"""Dataset preparation: split, per-feature scaler, label encoder, cropping, class selection.

All state tables (scaler, encoder) are small and keyed (feature / label); they are
broadcast where used. Their size bound: one row per feature, one row per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast
from chronoscope.functions.rand import sort_key60
from chronoscope.functions.ranking import global_rank

SEED = 42
SPLIT_FRACS = (0.7, 0.15, 0.15)
SPLIT_NAMES = ("train", "val", "test")


# --- E3 / I19: shuffled order -> split slices -------------------------------------------

def shuffle_rank(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """(noun_id, rank): 1-based position in the md5(seed|noun_id) order (ties by id)."""
    keyed = ids.select("noun_id").withColumn("_h", sort_key60(seed, F.col("noun_id")))
    return global_rank(keyed, "_h", ["noun_id"], "rank").drop("_h")


def assign_split(ids: DataFrame, fracs=SPLIT_FRACS, names=SPLIT_NAMES, seed: int = SEED) -> DataFrame:
    """(noun_id, split). Slice i has ceil(frac_i * n) rows from a running start; the last
    slice takes what is left (so it may be shorter)."""
    ranked = shuffle_rank(ids, seed)
    n = ids.select(F.count(F.lit(1)).cast("double")).scalar()
    bounds = []
    acc = F.lit(0).cast("bigint")
    for f in fracs[:-1]:
        acc = acc + F.ceil(F.lit(float(f)) * n).cast("bigint")
        bounds.append(acc)
    expr = F.lit(names[-1])
    for b, name in reversed(list(zip(bounds, names[:-1]))):
        expr = F.when(F.col("rank") <= b, F.lit(name)).otherwise(expr)
    return ranked.select("noun_id", expr.alias("split"))


def split_keeping_test(train_ids: DataFrame, test_ids: DataFrame, fracs=(0.85, 0.15), seed: int = SEED) -> DataFrame:
    """(noun_id, split) of an archive with a test part of its own: the other samples as `assign_split` has
    it, in train and val; the test part is kept whole."""
    return assign_split(train_ids, fracs, ("train", "val"), seed).unionByName(test_ids.select("noun_id", F.lit("test").alias("split")))


def split_ids(split_table: DataFrame, name: str) -> DataFrame:
    return split_table.where(F.col("split") == name).select("noun_id")


# --- D1 / I1: per-feature scaler ---------------------------------------------------------

def fit_scaler(cells: DataFrame, train_ids: DataFrame | None = None) -> DataFrame:
    """(feature, n, mean, s, std, min, max) over all steps of all (train) samples.

    s = sum of squared deviations (mergeable: Spark's partial/final variance buffers),
    std = sqrt(s / (n - 1)), 0 when n == 1.
    """
    src = cells if train_ids is None else cells.join(train_ids, "noun_id", "left_semi")
    return src.groupBy("feature").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        (F.var_pop("x") * F.count("x")).alias("s"),
        F.when(F.count("x") > 1, F.stddev_samp("x")).otherwise(F.lit(0.0)).alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def standardise(cells: DataFrame, scaler: DataFrame) -> DataFrame:
    """x' = (x - mean) / std per feature; std == 0 gives 0 (the reference divides by zero)."""
    st = bounded_broadcast(scaler.select("feature", "mean", "std"))
    return cells.join(st, "feature").select(
        "noun_id", "feature", "t",
        F.when(F.col("std") != 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0)).alias("x"))


def scale_minmax(cells: DataFrame, scaler: DataFrame) -> DataFrame:
    st = bounded_broadcast(scaler.select("feature", "min", "max"))
    rng = F.col("max") - F.col("min")
    return cells.join(st, "feature").select(
        "noun_id", "feature", "t",
        F.when(rng != 0, (F.col("x") - F.col("min")) / rng).otherwise(F.lit(0.0)).alias("x"))


def scale_mean(cells: DataFrame, scaler: DataFrame) -> DataFrame:
    st = bounded_broadcast(scaler.select("feature", "mean"))
    return cells.join(st, "feature").select("noun_id", "feature", "t", (F.col("x") - F.col("mean")).alias("x"))


# --- D2 / D3 / C7: label encoder -----------------------------------------------------------

def fit_encoder(targets: DataFrame, train_ids: DataFrame | None = None) -> DataFrame:
    """(target, class_idx, n): sorted distinct labels -> 0-based index, with class counts.
    Empty label -> "0" (as the reference's one-hot fit)."""
    src = targets if train_ids is None else targets.join(train_ids, "noun_id", "left_semi")
    lab = F.when(F.col("target") == "", F.lit("0")).otherwise(F.col("target"))
    counts = src.select(lab.alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    # counts has one row per class: the un-partitioned window runs over a bounded table
    return counts.select("target", (F.row_number().over(Window.orderBy("target")) - 1).cast("bigint").alias("class_idx"),
                         F.col("n").cast("bigint"))


def encode_targets(targets: DataFrame, encoder: DataFrame, unseen: str = "error") -> DataFrame:
    """(noun_id, target, class_idx). A label that the encoder has not seen is an error, raised when the
    row is read; unseen="drop" leaves such samples out instead."""
    lab = F.when(F.col("target") == "", F.lit("0")).otherwise(F.col("target"))
    side = bounded_broadcast(encoder.select("target", "class_idx"))
    named = targets.select("noun_id", lab.alias("target"))
    if unseen == "drop":
        return named.join(side, "target")
    message = F.concat(F.lit("label not seen by the encoder: "), F.coalesce("target", F.lit("null")))
    return named.join(side, "target", "left").withColumn("class_idx", F.coalesce("class_idx", F.raise_error(message).cast("bigint")))


# --- B10 / B11 / B2: cropping and minimum length -------------------------------------------

def resize(cells: DataFrame, new_len: int, cropping: str = "end") -> DataFrame:
    """Crop every sample to `new_len` steps: end keeps the first ones, start the last ones, both drops
    ceil(d / 2) of the d surplus steps at the front and floor(d / 2) at the back. Steps are renumbered
    from 0. Bounds outside a shorter sample follow array slicing: negative ones count from its end."""
    length = F.max("t").over(Window.partitionBy("noun_id")) + 1
    d = length - F.lit(new_len)
    bounds = {"end": (F.lit(0), F.lit(new_len)), "start": (d, length), "both": (F.ceil(d / 2), length - F.floor(d / 2))}
    if cropping not in bounds:
        raise ValueError(cropping)
    first, stop = (F.greatest(F.least(F.when(b < 0, b + length).otherwise(b), length), F.lit(0)) for b in bounds[cropping])
    return (cells.withColumn("_first", first).withColumn("_stop", stop)
            .where((F.col("t") >= F.col("_first")) & (F.col("t") < F.col("_stop")))
            .select("noun_id", "feature", (F.col("t") - F.col("_first")).cast("bigint").alias("t"), "x"))


def at_least_long(cells: DataFrame, lengths: DataFrame, least) -> DataFrame:
    """B2: cells of the samples with signal_length >= least. `lengths` (one row per sample) is filtered
    first, so a stored length column prunes before the cells are read."""
    return cells.join(lengths.where(F.col("signal_length") >= least).select("noun_id"), "noun_id", "left_semi")


def binary_target(labels: DataFrame, positive: str) -> DataFrame:
    """H6: labels (noun_id, labels array<string>) -> (noun_id, target): "1" if `positive` is among a
    sample's labels, else "0" (also for null or no labels)."""
    has = F.coalesce(F.array_contains("labels", positive), F.lit(False))
    return labels.select("noun_id", F.when(has, "1").otherwise("0").alias("target"))


def sample_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("noun_id").agg((F.max("t") + 1).cast("bigint").alias("signal_length"))


def min_length_quantile_of(length: str, q: float) -> Column:
    """Aggregate: the smallest length that keeps fraction q of samples, int(quantile(length, 1 - q)). The
    aggregate's buffer counts distinct lengths, of which there are at most as many as steps."""
    return F.floor(F.percentile(length, F.lit(1.0 - q))).cast("bigint")


def min_length_quantile(lengths: DataFrame, q: float) -> Column:
    return lengths.select(min_length_quantile_of("signal_length", q)).scalar()


# --- B9 / G2: class selection ---------------------------------------------------------------

def select_class_text(labels: Column, keep=None) -> Column:
    """The labels (array<string>) that are in `keep` (all if None) sorted and joined with ','; "0" if none."""
    named = F.array_remove(labels, "")
    kept = named if keep is None else F.array_intersect(named, F.array(*[F.lit(k) for k in keep]))
    joined = F.array_join(F.array_sort(F.array_distinct(kept)), ",")
    return F.when(joined != "", joined).otherwise(F.lit("0"))


def select_class(labels: DataFrame, keep: list[str]) -> DataFrame:
    """labels: (noun_id, labels array<string>) -> labels outside `keep` removed, joined with ','.
    Nothing left -> "0"."""
    return labels.select("noun_id", select_class_text(F.col("labels"), keep).alias("target"))


# --- B19 / B18 / F6 / F7: batching, sharding, epoch order --------------------------------------------

def batch_limit(ids: DataFrame, batch_size: int, seed: int = SEED) -> DataFrame:
    """(noun_id, batch_id): shuffled order, only full batches (floor(n / b) * b rows), batch_id =
    floor((position - 1) / b). The partial tail batch is dropped as the reference loader does."""
    keyed = ids.select("noun_id").withColumn("_h", sort_key60(seed, F.lit("batch"), "noun_id"))
    ranked = global_rank(keyed, "_h", ["noun_id"], "pos")
    n = ids.select(F.count(F.lit(1))).scalar()
    full = F.floor(n / batch_size) * batch_size
    return ranked.where(F.col("pos") <= full).select(
        "noun_id", F.floor((F.col("pos") - 1) / batch_size).cast("bigint").alias("batch_id"))


def shard_assign(ids: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(noun_id, shard): reader shard of every sample, pmod of its md5 draw."""
    from chronoscope.functions.rand import uniform_int
    return ids.select("noun_id", F.pmod(uniform_int(seed, F.lit("shard"), "noun_id"), F.lit(n_shards)).alias("shard"))


def epoch_order(ids: DataFrame, n_epochs: int, seed: int = SEED) -> DataFrame:
    """(epoch, noun_id, pos): a fresh shuffle per epoch (rows repeated once per epoch)."""
    e = ids.select("noun_id", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))).alias("epoch"))
    e = e.withColumn("_h", sort_key60(seed, F.lit("epoch"), "epoch", "noun_id"))
    return global_rank(e, "_h", ["noun_id"], "pos", group_cols=("epoch",)).select("epoch", "noun_id", "pos")


# --- C11 / C12: combine entity signals ------------------------------------------------------------------

def combine_entities(cells: DataFrame, layout: str = "entity") -> DataFrame:
    """cells (noun_id = window, entity, feature, t, x) -> (noun_id, feature, t, x) with the entities'
    features side by side: layout 'entity' numbers them e * F + f (A1 A2 A3 B1 B2 B3), layout
    'feature' f * E + e (A1 B1 A2 B2 A3 B3). All entities must have the same shape; a window
    whose entities differ in shape is flagged instead of combined (shape_ok = false)."""
    w = Window.partitionBy("noun_id")
    n_ent = F.size(F.collect_set("entity").over(w))
    n_feat = F.size(F.collect_set("feature").over(w))
    per_ent = Window.partitionBy("noun_id", "entity")
    shape = F.count(F.lit(1)).over(per_ent)
    c = cells.withColumn("_E", n_ent).withColumn("_F", n_feat).withColumn("_n", shape)
    c = c.withColumn("shape_ok", F.min("_n").over(w) == F.max("_n").over(w))
    new_f = (F.col("entity") * F.col("_F") + F.col("feature")) if layout == "entity" else (F.col("feature") * F.col("_E") + F.col("entity"))
    return c.select("noun_id", new_f.cast("bigint").alias("feature"), "t", "x", "shape_ok")
