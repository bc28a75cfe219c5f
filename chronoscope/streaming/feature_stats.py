"""L1: per-feature scaler statistics kept up to date as rows arrive (Structured Streaming).

The scaler (D1) is mergeable: blocks with (n, mean, s) combine to n = na + nb,
mean = mean_a + d nb / n, s = s_a + s_b + d^2 na nb / n with d = mean_b - mean_a. So the stream needs no
state store and no result in the driver. `foreachBatch` writes each micro-batch's own aggregate as a Parquet
folder `delta=<batch id>`; the statistics are the fold of all deltas in batch order. Every COMPACT_EVERY
batches the fold becomes a folder `base=<batch id>`, so a reader merges a bounded number of rows per key.

A batch that runs again replaces its own folder by the same rows: reruns change nothing. A folder counts once
its writer has committed it. A row that comes late adds to its window like any other; no watermark drops it,
and none is needed, as nothing is kept in memory. `trigger(availableNow=True)` processes what is there and
stops; given the same `state` folder, the next call reads only new files.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.session import checkpoint_dir

COMPACT_EVERY = 16


# --- the mergeable state --------------------------------------------------------------------------------------

def block_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., n, mean, s, min, max) of the rows; NaN counts as a value, null does not. A key without
    any value has n = 0."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("s"), F.min(v).alias("min"), F.max(v).alias("max"))


def merged_stats(blocks: DataFrame, keys: Sequence[str], order: str = "batch") -> DataFrame:
    """(keys..., n, mean, s, min, max): the blocks of every key folded in their order (at most
    COMPACT_EVERY + 1 rows a key, as older ones have been folded into a base)."""
    block = F.struct(F.col(order).alias("at"), "n", "mean", "s")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("s"))

    def fold(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["s"] + b["s"] + d * d * a["n"] * b["n"] / n).alias("s")))

    rows = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(block)).alias("_blocks"), F.min("min").alias("min"), F.max("max").alias("max"))
    rows = rows.withColumn("_all", F.aggregate("_blocks", start, fold))
    some = F.col("_all.n") > 0
    return rows.select(*keys, F.col("_all.n").alias("n"), F.when(some, F.col("_all.mean")).alias("mean"), F.when(some, F.col("_all.s")).alias("s"), "min", "max")


# --- its folders ----------------------------------------------------------------------------------------------

def _store(spark: SparkSession, path: str):
    """The file system behind a path, as Spark sees it, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _committed(spark: SparkSession, state: str) -> dict[str, list[int]]:
    """Batch ids of the committed folders, by kind (base, delta)."""
    fs, place = _store(spark, state)
    found: dict[str, list[int]] = {"base": [], "delta": []}
    if fs.exists(place):
        for entry in fs.listStatus(place):
            m = re.fullmatch(r"(base|delta)=(\d+)", entry.getPath().getName())
            if m and fs.exists(_store(spark, f"{state}/{m[0]}/_SUCCESS")[1]):
                found[m[1]].append(int(m[2]))
    return {kind: sorted(ids) for kind, ids in found.items()}


def _blocks(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame | None:
    """The newest base (before `upto`) and the deltas after it (up to `upto`), with their batch ids."""
    found = _committed(spark, state)
    bases = [b for b in found["base"] if upto is None or b < upto]
    base = max(bases, default=None)
    deltas = sorted(d for d in found["delta"] if (base is None or d > base) and (upto is None or d <= upto))
    folders = ([f"base={base}"] if base is not None else []) + [f"delta={d}" for d in deltas]
    if not folders:
        return None
    named = [spark.read.parquet(f"{state}/{f}").withColumn("batch", F.lit(int(f.split("=")[1]))) for f in folders]
    return reduce(DataFrame.unionByName, named)


def update_state(batch: DataFrame, batch_id: int, state: str, keys: Sequence[str], value: str, compact_every: int = COMPACT_EVERY) -> None:
    """Writes the batch's delta (again, if it ran before) and, every `compact_every` batches, a base. Folders
    that neither the newest base nor the one before it needs are removed: a rerun can still rebuild the newest."""
    spark = batch.sparkSession
    block_stats(batch, keys, value).write.mode("overwrite").parquet(f"{state}/delta={batch_id}")
    if batch_id % compact_every != compact_every - 1:
        return
    merged_stats(_blocks(spark, state, batch_id), keys).write.mode("overwrite").parquet(f"{state}/base={batch_id}")
    found = _committed(spark, state)
    before = max((b for b in found["base"] if b < batch_id), default=None)
    if before is not None:
        old = [f"base={b}" for b in found["base"] if b < before] + [f"delta={d}" for d in found["delta"] if d <= before]
        for name in old:
            fs, place = _store(spark, f"{state}/{name}")
            fs.delete(place, True)


def read_state(spark: SparkSession, state: str, keys: Sequence[str]) -> DataFrame | None:
    """(keys..., n, mean, std, min, max) as of the last batch, or None before the first; std as in D1."""
    blocks = _blocks(spark, state)
    if blocks is None:
        return None
    std = F.when(F.col("n") > 1, F.sqrt(F.col("s") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return merged_stats(blocks, keys).select(*keys, "n", "mean", std.alias("std"), "min", "max")


# --- the streams ----------------------------------------------------------------------------------------------

def _source(spark: SparkSession, path: str, schema, **opts) -> DataFrame:
    """A streaming file source over a folder; a single file is read as its folder + name filter. Which
    of the two a path is, is asked of the store that Spark reads."""
    reader = spark.readStream.schema(schema)
    for k, v in opts.items():
        reader = reader.option(k, v)
    fs, place = _store(spark, path)
    if fs.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def _kept_up_to_date(rows: DataFrame, keys: Sequence[str], value: str, state: str | None, compact_every: int) -> DataFrame:
    spark = rows.sparkSession
    state = state or os.path.join(checkpoint_dir(spark), f"feature_stats_{uuid.uuid4().hex[:12]}")
    query = (rows.writeStream.foreachBatch(lambda batch, batch_id: update_state(batch, batch_id, state, keys, value, compact_every))
             .option("checkpointLocation", f"{state}/_stream").trigger(availableNow=True).start())
    query.awaitTermination()
    found = read_state(spark, state, keys)
    if found is None:  # no file yet
        none = spark.createDataFrame([], rows.select(*keys, value).schema)
        found = block_stats(none, keys, value).select(*keys, "n", "mean", F.col("s").alias("std"), "min", "max")
    return found


def streaming_feature_stats(spark: SparkSession, path: str, schema, feature_col: str, value_col: str,
                            max_files_per_trigger: int = 1, state: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Run the stream over the files under `path` that `state` (a folder in shared storage) has not seen and
    return the per-feature table of all rows so far."""
    src = _source(spark, path, schema, maxFilesPerTrigger=max_files_per_trigger)
    rows = src.select(F.col(feature_col).alias("feature"), F.col(value_col).alias("value"))
    return _kept_up_to_date(rows, ["feature"], "value", state, compact_every)


def windowed_feature_stats(spark: SparkSession, path: str, schema, ts_col: str, feature_col: str, value_col: str, window: str = "1 day",
                           max_files_per_trigger: int = 1, state: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The same by tumbling event-time windows: all of them, also those that rows may still reach. Rows
    without an event time are left out."""
    src = _source(spark, path, schema, maxFilesPerTrigger=max_files_per_trigger)
    rows = src.select(F.window(F.col(ts_col).cast("timestamp"), window)["start"].alias("window_start"), F.col(feature_col).alias("feature"), F.col(value_col).alias("value"))
    return _kept_up_to_date(rows, ["window_start", "feature"], "value", state, compact_every)
