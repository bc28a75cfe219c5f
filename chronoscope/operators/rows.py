"""K0: preparing whole samples, one row each, with one fitted transform.

A row is (noun_id, signal array<array<double>> [step][feature], labels array<string>). `fit` reads the
training rows once and returns a `RowTransform`, whose size is one pair of numbers per feature and one entry
per class. `prepare_rows` is then a projection and a filter: minimum length, crop, NaN to 0, scale, transpose
to [feature][step], class selection, label encoding, all by higher-order functions over the row's own arrays.
Nothing is exploded, joined or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.functions.once import once
from chronoscope.operators.prepare import select_class_text

Encoding = Literal["label", "onehot", "binary"]
MOST_STATE = 100_000


@dataclass(frozen=True)
class RowTransform:
    """min_length: shorter samples are left out. length: steps that stay, cropped as `cropping` says (as in
    `prepare.resize`). mean, std: by feature; no scaling if None. keep: labels that count; all if None.
    classes: the encoder's classes in order."""
    min_length: int | None = None
    length: int | None = None
    cropping: str = "end"
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    keep: tuple[str, ...] | None = None
    classes: tuple[str, ...] = ()
    encoding: Encoding = "label"


def clean(x: Column) -> Column:
    """NaN and null count as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def cropped(signal: Column, length: int, cropping: str) -> Column:
    """B10 on one array: end keeps the first steps, start the last ones, both drops ceil(d / 2) of the d
    surplus steps at the front. Bounds outside a shorter signal follow array slicing."""
    size = F.size(signal)
    d = size - length
    bounds = {"end": (F.lit(0), F.lit(length)), "start": (d, size), "both": (F.ceil(d / 2).cast("int"), size - F.floor(d / 2).cast("int"))}
    if cropping not in bounds:
        raise ValueError(cropping)
    first, stop = (F.greatest(F.least(F.when(b < 0, b + size).otherwise(b), size), F.lit(0)) for b in bounds[cropping])
    return F.slice(signal, first + 1, F.greatest(stop - first, F.lit(0)))


def scaled_by_feature(signal: Column, n_features: int, mean, std) -> Column:
    """[step][feature] -> [feature][step], standardised; a feature without spread gives 0."""
    def series(signal: Column, f: Column) -> Column:
        if mean is None:
            return F.transform(signal, lambda row: clean(F.get(row, f)))
        m, s = F.get(F.lit(list(mean)), f), F.get(F.lit(list(std)), f)
        return F.transform(signal, lambda row: F.when(s != 0, (clean(F.get(row, f)) - m) / s).otherwise(F.lit(0.0)))

    features = F.sequence(F.lit(0), F.lit(n_features - 1))
    return once(signal, lambda x: F.transform(features, lambda f: series(x, f)))


def encoded(target: Column, transform: RowTransform) -> Column:
    """Class index, 0-1 array over the classes, or whether any label counts. A label that the
    encoder has not seen is an error."""
    if transform.encoding == "binary":
        return (target != "0").cast("int")
    position = F.array_position(F.lit(list(transform.classes)), target)
    message = F.concat(F.lit("label not seen by the encoder: "), F.coalesce(target, F.lit("null")))
    index = F.when(position > 0, position - 1).otherwise(F.raise_error(message).cast("bigint"))
    if transform.encoding == "label":
        return index
    return F.transform(F.sequence(F.lit(0), F.lit(len(transform.classes) - 1)), lambda k: (k == index).cast("int"))


def fit(rows: DataFrame, transform: RowTransform = RowTransform(), scale: bool = True) -> RowTransform:
    """The transform with what the training rows say: mean and std by feature over all steps (D1; of the
    samples that the length allows, before the crop) and the classes (D3). Two aggregates with map-side
    partials; the driver gets one row per feature and per class (at most MOST_STATE)."""
    long_enough = _long_enough(rows, transform)
    mean = std = None
    if scale:
        cells = long_enough.select(F.explode("signal").alias("row")).select(F.posexplode("row").alias("feature", "x"))
        x = clean(F.col("x"))
        spread = F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.lit(0.0))
        found = cells.groupBy("feature").agg(F.avg(x).alias("mean"), spread.alias("std")).orderBy("feature").limit(MOST_STATE + 1).collect()
        mean, std = tuple(r["mean"] for r in found), tuple(r["std"] for r in found)
    target = select_class_text(F.col("labels"), transform.keep)
    found = long_enough.select(target.alias("target")).distinct().orderBy("target").limit(MOST_STATE + 1).collect()
    if len(found) > MOST_STATE or len(mean or ()) > MOST_STATE:
        raise ValueError(f"more than {MOST_STATE} features or classes")
    return replace(transform, mean=mean, std=std, classes=tuple(r["target"] for r in found))


def _long_enough(rows: DataFrame, transform: RowTransform) -> DataFrame:
    return rows if transform.min_length is None else rows.where(F.size("signal") >= transform.min_length)


def prepare_rows(rows: DataFrame, transform: RowTransform, n_features: int | None = None) -> DataFrame:
    """(noun_id, signal [feature][step], target, encoded): the rows that are long enough, transformed.
    target is the text of the labels that count ("0" for none). n_features is needed without a scaler."""
    n = len(transform.mean) if transform.mean is not None else n_features
    if not n:
        raise ValueError("n_features is needed where nothing is scaled")
    signal = F.col("signal") if transform.length is None else cropped(F.col("signal"), transform.length, transform.cropping)
    ready = _long_enough(rows, transform).select("noun_id", signal.alias("signal"), select_class_text(F.col("labels"), transform.keep).alias("target"))
    return ready.select("noun_id", scaled_by_feature(F.col("signal"), n, transform.mean, transform.std).alias("signal"), "target", encoded(F.col("target"), transform).alias("encoded"))


def prepared_cells(ready: DataFrame, keep: tuple[str, ...] = ("noun_id",)) -> DataFrame:
    """(keep..., feature, t, x) of prepared rows."""
    series = ready.select(*keep, F.posexplode("signal").alias("feature", "_x"))
    return series.select(*keep, F.col("feature").cast("bigint"), F.posexplode("_x").alias("t", "x")).select(*keep, "feature", F.col("t").cast("bigint"), "x")
