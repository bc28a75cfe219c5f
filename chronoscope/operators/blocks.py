"""Random block masks with an enforced fraction (I10 / I18), and the scores of corrupted samples.

One sample is one row: its cells, and for every method and grid point what is to be masked. The draws depend on
(seed, grid point, sample, cell) and not on the method, so a batch function makes them once for all methods,
four uniforms of each md5, as many attempts as are needed. Nothing is expanded by grid point or attempt before
a shuffle, and a corrupted signal exists only inside the task that scores it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.functions.ranking import spread
from chronoscope.operators.network import Network, positions

MAX_ATTEMPTS = 26      # draws until |p - drop_prob| <= .05, at most 26
ENFORCE_TOL = 0.05
GAMMA_FACTOR = 1.2
EPS_LN = 2.0 ** -33
#: As many values at least does a corrupted signal go through the model with others.
SCORED_CELLS = 1 << 20


# --- draws of one sample ----------------------------------------------------------------------------------------

def _words(prefix: str, names: list[str], suffix: str = "") -> np.ndarray:
    """The four 32-bit numbers of md5(prefix|name+suffix) for every name."""
    raw = b"".join(hashlib.md5(f"{prefix}|{n}{suffix}".encode()).digest() for n in names)
    return np.frombuffer(raw, ">u4").reshape(len(names), 4)


def normals(seed: int, kind: str, g: int, noun_id: int, names: list[str]) -> np.ndarray:
    """The draws of `rand.normal(seed, kind, g, noun_id, feature, t)` for the cells named feature|t."""
    u = _words(f"{seed}|{kind}|{g}|{noun_id}", names)[:, :2] / 2.0 ** 32
    return np.sqrt(-2.0 * np.log(u[:, 0] + EPS_LN)) * np.cos(2.0 * math.pi * u[:, 1])


class Draws:
    """Uniform draws of a sample's cells for the attempts at one grid point, four attempts at a time."""

    def __init__(self, seed: int, g: int, noun_id: int, names: list[str]):
        self.prefix, self.names, self.made = f"{seed}|rb|{g}|{noun_id}", names, []

    def four(self, k: int) -> np.ndarray:
        while len(self.made) <= k:
            self.made.append(_words(self.prefix, self.names, f"|{len(self.made)}").T / 2.0 ** 32)
        return self.made[k]


# --- masks --------------------------------------------------------------------------------------------------------

def dilated(seeds: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """seeds (.., step): step t is masked if a seed lies in [t - block // 2, t + block - 1 - block // 2]. Also
    the number of masked steps, with the extra column of even blocks where a seed is in the last half block."""
    steps = seeds.shape[-1]
    low, high = block // 2, block - 1 - block // 2
    before = np.zeros((*seeds.shape[:-1], steps + 1), np.int32)
    np.cumsum(seeds, axis=-1, out=before[..., 1:])
    t = np.arange(steps)
    masked = before[..., np.minimum(t + high, steps - 1) + 1] > before[..., np.maximum(t - low, 0)]
    count = masked.sum(axis=-1)
    if block % 2 == 0:
        count = count + seeds[..., max(0, math.ceil(steps - block / 2)):].any(axis=-1)
    return masked, count


def enforced_mask(draws: Draws, place: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], drop_prob: float, block: int) -> np.ndarray:
    """Which cells are masked, by the first attempt that masks the fraction drop_prob within ENFORCE_TOL, else
    by the closest (first on ties). place: row (feature) and step of every cell in the grid `shape`. Seeds are
    drawn with probability clip(p / b * T / (T - b + 1) * GAMMA_FACTOR, 0, 1); the fraction is of the grid."""
    n_steps = shape[1]
    # the quotient of longer blocks than steps follows float rules: x / 0 is infinite
    room = n_steps - block + 1
    gamma = drop_prob / block * (n_steps / room if room else math.inf) * GAMMA_FACTOR
    gamma = min(max(gamma, 0.0), 1.0)
    best, best_diff = None, math.inf
    for k in range((MAX_ATTEMPTS + 3) // 4):
        u = draws.four(k)[:MAX_ATTEMPTS - 4 * k]
        seeds = np.zeros((len(u), *shape), bool)
        seeds[:, place[0], place[1]] = u < gamma
        masked, count = dilated(seeds, block)
        diffs = np.abs(drop_prob - count.sum(axis=1) / (shape[0] * shape[1]))
        good = np.flatnonzero(diffs <= ENFORCE_TOL)
        at = int(good[0]) if len(good) else int(diffs.argmin())
        if len(good) or diffs[at] < best_diff:
            best, best_diff = masked[at], diffs[at]
        if len(good):
            break
    return best[place]


def _sample(cells: list[dict]) -> tuple[np.ndarray, np.ndarray, list[str], tuple[np.ndarray, np.ndarray]]:
    feature, t = (np.array([c[k] for c in cells], np.int64) for k in ("feature", "t"))
    return feature, t, [f"{f}|{s}" for f, s in zip(feature.tolist(), t.tolist())], (np.unique(feature, return_inverse=True)[1], t)


# --- I10: masked cells ----------------------------------------------------------------------------------------------

def random_block_mask(rel: DataFrame, sm: DataFrame, seed: int) -> DataFrame:
    """(method, noun_id, g, feature, t, x) of the cells that the random block draw masks. sm: (method, noun_id,
    g, drop_prob, block_size, n_steps, n_feat)."""
    asked = sm.groupBy("method", "noun_id").agg(F.collect_list(F.struct("g", "drop_prob", F.col("block_size").cast("int").alias("block_size"))).alias("asked"),
                                                F.first("n_feat").alias("n_feat"), F.first("n_steps").alias("n_steps"))
    per_method = rel.groupBy("method", "noun_id").agg(F.sort_array(F.collect_list(F.struct("feature", "t", "x"))).alias("cells")).join(asked, ["method", "noun_id"])
    rows = per_method.groupBy("noun_id").agg(F.collect_list(F.struct("method", "cells", "asked", "n_feat", "n_steps")).alias("methods"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, methods in zip(batch.column("noun_id").to_pylist(), batch.column("methods")):
                made: dict = {}
                out: list[tuple] = []
                for m in methods.as_py():
                    feature, t, names, place = _sample(m["cells"])
                    for p in m["asked"]:
                        draws = made.setdefault((p["g"], tuple(names)), Draws(seed, p["g"], i, names))
                        hit = np.flatnonzero(enforced_mask(draws, place, (m["n_feat"], m["n_steps"]), p["drop_prob"], p["block_size"]))
                        out += [(m["method"], i, p["g"], int(feature[k]), int(t[k]), m["cells"][k]["x"]) for k in hit]
                if out:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["method", "noun_id", "g", "feature", "t", "x"])

    return rows.mapInArrow(run, "method string, noun_id long, g long, feature long, t long, x double")


# --- K2: scores of corrupted samples ----------------------------------------------------------------------------------

def corrupted_logits(rel: DataFrame, stats: DataFrame, sm: DataFrame, net: Network, n_top: int, seed: int) -> DataFrame:
    """(method, noun_id, g, z2, z3): the logits after the kept cells, and after the cells of the random block
    mask, have taken N(0,1) draws. rel: (method, noun_id, feature, t, x, r); stats: bound by grid point (the
    first n_top of them keep r >= bound, the others r <= bound, both of r >= 0); sm as in random_block_mask.
    Everything is keyed by noun_id, and a sample is bounded by methods x features x steps."""
    asked = sm.groupBy("method", "noun_id").agg(F.collect_list(F.struct(F.col("g").cast("int").alias("g"), "drop_prob", F.col("block_size").cast("int").alias("block_size"))).alias("asked"))
    per_method = rel.groupBy("method", "noun_id").agg(F.sort_array(F.collect_list(F.struct("feature", "t", "x", "r"))).alias("cells"))
    per_method = per_method.join(stats.select("method", "noun_id", "bound", "n_feat", "n_steps"), ["method", "noun_id"]).join(asked, ["method", "noun_id"])
    # a sample costs time, not bytes: its partitions are not merged into a few tasks
    rows = spread(per_method, "noun_id").groupBy("noun_id").agg(F.collect_list(F.struct("method", "cells", "bound", "asked", "n_feat", "n_steps")).alias("methods"))
    shipped = rel.sparkSession.sparkContext.broadcast(net.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shipped.value)
        held: list[tuple] = []  # (method, noun_id, g) of the signals that wait for the model
        signals: list[np.ndarray] = []

        def scored():
            z = net.logits(np.array(signals)).reshape(len(held), 2, -1)
            lists = pa.list_(pa.float64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*held), (pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(z[:, 0]), lists), pa.array(list(z[:, 1]), lists)], names=["method", "noun_id", "g", "z2", "z3"])

        for batch in batches:
            for i, methods in zip(batch.column("noun_id").to_pylist(), batch.column("methods")):
                made: dict = {}  # draws by grid point (and cells, should methods differ in them)
                for m in methods.as_py():
                    feature, t, names, place = _sample(m["cells"])
                    col, r = positions(net, feature, t), np.array([np.nan if c["r"] is None else c["r"] for c in m["cells"]], float)
                    x = np.zeros(net.n_cells)
                    x[col] = [c["x"] for c in m["cells"]]
                    for p in m["asked"]:
                        g = p["g"]
                        if (g, tuple(names)) not in made:
                            made[g, tuple(names)] = (normals(seed, "corrupt", g, i, names), normals(seed, "random", g, i, names), Draws(seed, g, i, names))
                        noise2, noise3, draws = made[g, tuple(names)]
                        kept = (r >= 0) & (r >= m["bound"][g] if g < n_top else r <= m["bound"][g])
                        masked = enforced_mask(draws, place, (m["n_feat"], m["n_steps"]), p["drop_prob"], p["block_size"])
                        for hit, noise in ((kept, noise2), (masked, noise3)):
                            new = x.copy()
                            new[col[hit]] = noise[hit]
                            signals.append(new)
                        held.append((m["method"], i, g))
                if len(held) * net.n_cells >= SCORED_CELLS:
                    yield scored()
                    held, signals = [], []
        if held:
            yield scored()

    return rows.mapInArrow(run, "method string, noun_id long, g long, z2 array<double>, z3 array<double>")
