"""Signal augmentation operators (I2-I15) on long-form cells (noun_id, feature, t, x).

Randomness is md5-keyed (chronoscope.functions.rand), so every operator is a pure
function of its input and seed, independent of partitioning. Per-series statistics are
window aggregates over (noun_id, feature); dilation of block masks uses the nearest seed
before / after each step (unbounded frames), which handles a per-row block width.
Operators that need values at other steps of the same series (window_slice,
permute_block) gather the series into one array (bounded by its length T).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast
from chronoscope.functions.rand import normal, sort_key60, uniform

SEED = 42


def _series_window():
    return Window.partitionBy("noun_id", "feature")


def _n_steps() -> Column:
    return F.max("t").over(_series_window()) + 1


def jitter(cells: DataFrame, sigma: float = 0.1, seed: int = SEED) -> DataFrame:
    """X + N(0, (sigma * std_t(x))^2), std over the steps of each series (sample std)."""
    sd = F.stddev_samp("x").over(_series_window())
    return cells.select("noun_id", "feature", "t",
                        (F.col("x") + normal(seed, F.lit("jitter"), "noun_id", "feature", "t") * sd * F.lit(sigma)).alias("x"))


def scaling(cells: DataFrame, sigma: float = 0.1, seed: int = SEED) -> DataFrame:
    """X * N(1, sigma^2), one factor per series."""
    factor = F.lit(1.0) + F.lit(sigma) * normal(seed, F.lit("scaling"), "noun_id", "feature")
    return cells.select("noun_id", "feature", "t", (F.col("x") * factor).alias("x"))


def flip_y(cells: DataFrame, seed: int = SEED) -> DataFrame:
    """I4: x * (+1 or -1), one sign per series."""
    sign = F.when(uniform(seed, F.lit("flip"), "noun_id", "feature") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    return cells.select("noun_id", "feature", "t", (F.col("x") * sign).alias("x"))


def shuffle_channel(cells: DataFrame, seed: int = SEED) -> DataFrame:
    """One permutation of the features for the whole collection: output channel i holds the
    input channel with the i-th smallest draw. The feature table is bounded by F."""
    feats = cells.select("feature").distinct().withColumn("_h", uniform(seed, F.lit("shuffle_channel"), "feature"))
    perm = feats.select(F.col("feature").alias("_src"),
                        (F.row_number().over(Window.orderBy("_h", "feature")) - 1).cast("bigint").alias("_dst"))
    rank = feats.select(F.col("feature").alias("_pos"),
                        (F.row_number().over(Window.orderBy("feature")) - 1).cast("bigint").alias("_dst"))
    m = perm.join(rank, "_dst").select("_src", F.col("_pos").alias("new_feature"))
    return cells.join(bounded_broadcast(m), cells["feature"] == m["_src"]).select(
        "noun_id", F.col("new_feature").alias("feature"), "t", "x")


def _series_arrays(cells: DataFrame) -> DataFrame:
    """(noun_id, feature, xs): the values of each series in time order (bounded by T)."""
    return cells.groupBy("noun_id", "feature").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("xs"))


def window_slice(cells: DataFrame, reduce_ratio: float = 0.8, seed: int = SEED) -> DataFrame:
    """Keep ceil(ratio*T) steps from one random start shared by the collection, stretch back
    to T by nearest neighbour: out[t] = in[start + floor(t * L / T)]. Identity when L >= T."""
    arr = _series_arrays(cells)
    T = F.size("xs")
    L = F.ceil(F.lit(reduce_ratio) * T).cast("int")
    start = F.floor(uniform(seed, F.lit("window_slice")) * (T - L)).cast("int")
    idx = F.transform(F.sequence(F.lit(0), T - 1),
                      lambda i: F.when(L >= T, i).otherwise(start + F.floor(i * L / T).cast("int")))
    out = arr.select("noun_id", "feature", F.transform(idx, lambda j: F.element_at("xs", j + 1)).alias("ys"))
    return out.select("noun_id", "feature", F.posexplode("ys").alias("t", "x")).select(
        "noun_id", "feature", F.col("t").cast("bigint"), "x")


def _block_mask(cells: DataFrame, p: Column, b: Column, factor: float, key: str, seed: int) -> DataFrame:
    """Adds _m: Bernoulli(gamma) seeds per cell, gamma = p / b * T / (T - b + 1) * factor (clipped to
    [0, 1]), dilated by a max-pool of width b (b // 2 steps before, b - 1 - b // 2 after)."""
    T = _n_steps()
    gamma = F.least(F.greatest(p / b * (T / (T - b + 1)) * F.lit(factor), F.lit(0.0)), F.lit(1.0))
    c = cells.withColumn("_b", b).withColumn("_seed", uniform(seed, F.lit(key), "noun_id", "feature", "t") < gamma)
    w = Window.partitionBy("noun_id", "feature").orderBy("t")
    st_t = F.when(F.col("_seed"), F.col("t"))
    prev = F.max(st_t).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.min(st_t).over(w.rowsBetween(0, Window.unboundedFollowing))
    lo = F.floor(F.col("_b") / 2)
    hi = F.col("_b") - 1 - lo
    m = F.coalesce((F.col("t") - prev) <= lo, F.lit(False)) | F.coalesce((nxt - F.col("t")) <= hi, F.lit(False))
    return c.withColumn("_m", m)


def drop_block(cells: DataFrame, drop_prob: float = 0.1, block_size: int = 7, scale: bool = False, seed: int = SEED) -> DataFrame:
    """Masked blocks set to 0; with scale, rescaled by cells / kept cells of the series."""
    c = _block_mask(cells, F.lit(drop_prob), F.lit(block_size), 1.1, "drop_block", seed)
    out = F.when(F.col("_m"), F.lit(0.0)).otherwise(F.col("x"))
    if scale:
        w = _series_window()
        kept = F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(w)
        out = out * F.count(F.lit(1)).over(w) / kept
    return c.select("noun_id", "feature", "t", out.alias("x"))


def random_block(cells: DataFrame, drop_prob: float = 0.1, block_size: int = 7, seed: int = SEED) -> DataFrame:
    """I8: masked blocks replaced by N(0, 1)."""
    c = _block_mask(cells, F.lit(drop_prob), F.lit(block_size), 1.1, "random_block", seed)
    noise = normal(seed, F.lit("random_block_n"), "noun_id", "feature", "t")
    return c.select("noun_id", "feature", "t", F.when(F.col("_m"), noise).otherwise(F.col("x")).alias("x"))


def permute_block(cells: DataFrame, drop_prob: float = 0.1, block_size: int = 7, seed: int = SEED) -> DataFrame:
    """Masked cells take the value at the same step of a random permutation of the series
    (permutation = steps ordered by their draw)."""
    c = _block_mask(cells, F.lit(drop_prob), F.lit(block_size), 1.2, "permute_block", seed)
    perm = cells.withColumn("_u", uniform(seed, F.lit("permute"), "noun_id", "feature", "t")).groupBy("noun_id", "feature").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_u", "t", "x"))), lambda s: s["x"]).alias("_px"))
    j = c.join(perm, ["noun_id", "feature"])
    return j.select("noun_id", "feature", "t",
                    F.when(F.col("_m"), F.element_at("_px", (F.col("t") + 1).cast("int"))).otherwise(F.col("x")).alias("x"))


def random_block_enforce(cells: DataFrame, drop_prob: float = 0.1, block_size: int = 7, seed: int = SEED) -> DataFrame:
    """Random blocks with the drawn fraction enforced (best of up to 26 draws); the same
    operator as the random corruption of the sweep, with fixed (p, b) for every sample."""
    from chronoscope.operators.blocks import random_block_mask
    dims = cells.groupBy("noun_id").agg((F.max("t") + 1).alias("n_steps"), F.count_distinct("feature").alias("n_feat"))
    sm = dims.select(F.lit("-").alias("method"), "noun_id", F.lit(0).cast("bigint").alias("g"),
                     F.lit(float(drop_prob)).alias("drop_prob"), F.lit(block_size).alias("block_size"), "n_steps", "n_feat")
    rel = cells.select(F.lit("-").alias("method"), "noun_id", "feature", "t", "x")
    masked = random_block_mask(rel, sm, seed).select("noun_id", "feature", "t", F.lit(True).alias("_m"))
    j = cells.join(masked, ["noun_id", "feature", "t"], "left")
    noise = normal(seed, F.lit("random"), F.lit(0), "noun_id", "feature", "t")
    return j.select("noun_id", "feature", "t", F.when(F.col("_m"), noise).otherwise(F.col("x")).alias("x"))


def signal_power(cells: DataFrame) -> DataFrame:
    """(noun_id, feature, power_db) = 10 log10(mean(x^2)) per series."""
    p = F.avg(F.col("x") * F.col("x"))
    return cells.groupBy("noun_id", "feature").agg(F.when(p > 0, F.lit(10.0) * F.log10(p)).alias("power_db"))


def add_noise_snr(cells: DataFrame, target_db: float = 20.0, seed: int = SEED) -> DataFrame:
    """X + N(0, sigma^2), sigma^2 = 10^((signal_db - target_db) / 10) per series."""
    p = F.avg(F.col("x") * F.col("x")).over(_series_window())
    var = F.when(p > 0, F.pow(F.lit(10.0), (F.lit(10.0) * F.log10(p) - F.lit(target_db)) / F.lit(10.0))).otherwise(F.lit(0.0))
    return cells.select("noun_id", "feature", "t",
                        (F.col("x") + F.sqrt(var) * normal(seed, F.lit("snr"), "noun_id", "feature", "t")).alias("x"))


def inject_pattern(cells: DataFrame, wave: str = "sin", freq: int = 3, length_ratio: float = 0.5, seed: int = SEED) -> DataFrame:
    """Add sin(linspace(0, 2 pi f, n))[t - start] (or its sign, or nothing for 'line') on
    [start, start + n) of every series; n = floor(ratio * T), start drawn per sample."""
    T = _n_steps()
    n = F.floor(F.lit(length_ratio) * T)
    start = F.floor(uniform(seed, F.lit("pattern"), "noun_id") * (T - n + 1))
    i = F.col("t") - start
    phase = F.lit(2.0 * math.pi * freq) * i / F.greatest(n - 1, F.lit(1))
    if wave == "sin":
        pat = F.sin(phase)
    elif wave == "square":
        pat = F.signum(F.sin(phase))
    else:
        pat = F.lit(0.0)
    inside = (i >= 0) & (i < n)
    return cells.select("noun_id", "feature", "t", (F.col("x") + F.when(inside, pat).otherwise(F.lit(0.0))).alias("x"),
                        start.cast("bigint").alias("pattern_start"))


def pattern_plan(cells: DataFrame, n_support: int, f_support: tuple[int, int], f_base: tuple[float, float], n_sine: int = 2, seed: int = SEED) -> DataFrame:
    """(noun_id, feature, place, wave, f_support, f_base, start): one row per series. A sample's features are
    put in a random order without replacement; the first n_sine carry a sine, each other one a line or a
    square wave. f_support is a whole number of [low, high), f_base of a continuous range, start such that
    n_support steps fit."""
    series = cells.groupBy("noun_id", "feature").agg((F.max("t") + 1).alias("_T")).withColumn("_o", sort_key60(seed, F.lit("pat_o"), "noun_id", "feature"))
    place = F.row_number().over(Window.partitionBy("noun_id").orderBy("_o", "feature")) - 1

    def draw(name):
        return uniform(seed, F.lit(name), "noun_id", "feature")

    rows = series.withColumn("place", place.cast("bigint"))
    wave = F.when(F.col("place") < n_sine, "sine").when(draw("pat_w") < 0.5, "line").otherwise("square")
    return rows.select("noun_id", "feature", "place", wave.alias("wave"),
                       (F.floor(draw("pat_f") * (f_support[1] - f_support[0])) + f_support[0]).cast("bigint").alias("f_support"),
                       (draw("pat_b") * (f_base[1] - f_base[0]) + f_base[0]).alias("f_base"),
                       F.floor(draw("pat_s") * (F.greatest(F.col("_T") - n_support, F.lit(0)) + 1)).cast("bigint").alias("start"))


def inject_patterns(cells: DataFrame, plan: DataFrame, n_support: int) -> DataFrame:
    """The cells with each series' wave added on [start, start + n_support), always from its own t = 0."""
    i = F.col("t") - F.col("start")
    phase = F.lit(2.0 * math.pi) * F.col("f_support") * i / F.lit(max(n_support - 1, 1))
    value = F.when(F.col("wave") == "sine", F.sin(phase)).when(F.col("wave") == "square", F.signum(F.sin(phase))).otherwise(F.lit(0.0))
    j = cells.join(plan, ["noun_id", "feature"])
    return j.select("noun_id", "feature", "t", (F.col("x") + F.when((i >= 0) & (i < n_support), value).otherwise(F.lit(0.0))).alias("x"))


def pattern_truth(plan: DataFrame) -> DataFrame:
    """(noun_id, pos_sin_wave, feature_idx_sin_wave, f_sine_sum, f_sine_ratio): where a sample's sines are, in
    the drawn order, and what its labels are made of."""
    sines = plan.where(F.col("wave") == "sine").groupBy("noun_id").agg(F.sort_array(F.collect_list(F.struct("place", "start", "feature", "f_support", "f_base"))).alias("s"))
    ratio = F.aggregate("s", F.lit(0.0), lambda acc, s: acc + s["f_support"] / s["f_base"])
    return sines.select("noun_id", F.transform("s", lambda s: s["start"]).alias("pos_sin_wave"), F.transform("s", lambda s: s["feature"]).alias("feature_idx_sin_wave"),
                        F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, s: acc + s["f_support"]).alias("f_sine_sum"), ratio.alias("f_sine_ratio"))


def pattern_labels(truth: DataFrame, quantiles=(0.5, 1.0)) -> DataFrame:
    """(noun_id, target_sum, target_ratio): the quantile classes of both sums over all samples."""
    from chronoscope.functions.ranking import exact_quantiles
    from chronoscope.session import materialize
    from chronoscope.sources.signals import label_rule
    kept = materialize(truth.select("noun_id", "f_sine_sum", "f_sine_ratio"))
    named = [label_rule(F.col(c), F.array(*[F.lit(v) for v in exact_quantiles(kept, c, quantiles)])).cast("string").alias(out) for c, out in (("f_sine_sum", "target_sum"), ("f_sine_ratio", "target_ratio"))]
    return kept.select("noun_id", *named)


def weighted_choice(draw_keys: DataFrame, values: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """`size` draws with replacement per key from `values` (value, weight) (bounded table):
    the first value whose cumulative weight exceeds u * total."""
    cum = values.select("value", F.sum("weight").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("_cw"),
                        F.sum("weight").over(Window.partitionBy()).alias("_tot"))
    table = cum.select(F.sort_array(F.collect_list(F.struct("_cw", "value"))).alias("_tab"), F.max("_tot").alias("_tot"))
    tab = table.select("_tab").scalar()
    tot = table.select("_tot").scalar()
    d = draw_keys.select("noun_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("draw"))
    d = d.withColumn("_u", uniform(seed, F.lit("choice"), "noun_id", "draw") * tot).withColumn("_tab", tab)
    pick = F.filter("_tab", lambda s: s["_cw"] > F.col("_u"))
    return d.select("noun_id", "draw", F.element_at(pick, 1)["value"].alias("value"))


# --- I12: RandAugment ----------------------------------------------------------------------------------

# fixed values: RandAugment operation space (name, magnitude grid low, high; 11 bins)
RAND_AUGMENT_OPS = [
    ("Identity", None, None),
    ("Jitter", 0.0, 0.8),
    ("Scaling", 0.0, 0.5),
    ("Flip_Y", None, None),
    ("Window_slice", 1.0, 0.4),
    ("Drop_block", 0.0, 0.8),
    ("Random_block", 0.0, 0.8),
    ("Permute_block", 0.0, 0.8),
    ("Shuffle_block", 0.0, 0.8),
]
N_BINS = 11


def _draw(seed: int, *keys) -> float:
    import hashlib
    h = hashlib.md5("|".join([str(seed)] + [str(k) for k in keys]).encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def rand_augment_choice(epoch: int, magnitude: int = 3, seed: int = SEED, ops=None, nth: int = 0) -> tuple[str, float]:
    """(op, magnitude) of the nth operation of one call: op uniform over the space (`ops`: names to
    choose from, default all), magnitude ~ U(grid[0], grid[bound]), bound = int(epoch / 25 *
    magnitude) before epoch 15, else magnitude. Drawn from md5 (driver-side scalar parameters of the
    plan, not data)."""
    space = [o for o in RAND_AUGMENT_OPS if ops is None or o[0] in ops]
    key = ("randaugment", epoch) if not nth else ("randaugment", epoch, nth)
    name, lo, hi = space[int(_draw(seed, *key, "op") * len(space))]
    if lo is None:
        return name, 0.0
    bound = int(epoch / 25 * magnitude) if epoch < 15 else magnitude
    grid_b = lo + (hi - lo) * bound / (N_BINS - 1)
    return name, lo + _draw(seed, *key, "mag") * (grid_b - lo)


def rand_augment(cells: DataFrame, epoch: int, magnitude: int = 3, seed: int = SEED, ops=None, n_ops: int = 1) -> DataFrame:
    """`n_ops` drawn operations, one after the other."""
    apply = {
        "Jitter": lambda c, m: jitter(c, m, seed), "Scaling": lambda c, m: scaling(c, m, seed), "Flip_Y": lambda c, m: flip_y(c, seed),
        "Window_slice": lambda c, m: window_slice(c, 0.8, seed),  # the operation ignores its magnitude
        "Drop_block": lambda c, m: drop_block(c, m, 7, False, seed), "Random_block": lambda c, m: random_block(c, m, 7, seed),
        "Permute_block": lambda c, m: permute_block(c, m, 7, seed), "Shuffle_block": lambda c, m: block_shuffle(c, m, 7, seed),
        "Identity": lambda c, m: c,
    }
    out = cells.select("noun_id", "feature", "t", "x")
    for nth in range(n_ops):
        name, mag = rand_augment_choice(epoch, magnitude, seed, ops, nth)
        out = apply[name](out, mag)
    return out


# --- I11: random block shuffle: one permutation per (feature, length) -------------------------------------

def shuffle_map(feature: int, length: int, drop_prob: float, block_size: int, seed: int) -> list[int]:
    """Source step of every step after all block permutations, which compound in time order."""
    gamma = drop_prob / block_size * (length / (length - block_size + 1)) * 1.1
    source = list(range(length))
    for step in range(length):
        if _draw(seed, "shuffle_block", feature, step) < gamma:
            block = source[step:step + block_size]
            order = sorted(range(len(block)), key=lambda j: (_draw(seed, "shuffle_perm", feature, step, j), j))
            source[step:step + block_size] = [block[j] for j in order]
    return source


def block_shuffle(cells: DataFrame, drop_prob: float = 0.1, block_size: int = 7, seed: int = SEED) -> DataFrame:
    """Seeds Bernoulli(gamma) per (feature, t) shared by all samples (gamma factor 1.1); at each seed
    in time order the next b values (clipped at T) are permuted by one permutation shared by all
    samples; overlapping blocks compound. The draws depend on feature and length alone, so the steps
    are composed once per (feature, length) into a map, and the cells are joined with it."""
    import pandas as pd

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f, length = int(pdf["feature"].iloc[0]), int(pdf["_T"].iloc[0])
        return pd.DataFrame({"feature": f, "_T": length, "_to": range(length), "_from": shuffle_map(f, length, drop_prob, block_size, seed)})

    sized = cells.withColumn("_T", (F.max("t").over(Window.partitionBy("noun_id", "feature")) + 1).cast("bigint"))
    maps = sized.select("feature", "_T").distinct().groupBy("feature", "_T").applyInPandas(fn, "feature long, _T long, _to long, _from long")
    return (sized.join(maps.withColumnRenamed("_from", "t"), ["feature", "_T", "t"])
            .select("noun_id", "feature", F.col("_to").alias("t"), "x"))
