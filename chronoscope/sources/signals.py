"""Turning driver tables into labelled signal collections (long form).

cells:   (noun_id bigint, feature bigint, t bigint, x double)
targets: (noun_id bigint, target string)

* embeddings: each vector is a univariate series (feature 0, t = array position),
  target = label.
* events:     entity = user_id, channel = event_type (sorted, 0-based), step = day
  since the first day in the table, x = sum(value); empty bins are 0 (same rule as
  NaN -> 0 at ingest). Target from the quantile rule on each user's total.
* lineitem:   entity = l_suppkey, channel = l_returnflag, step = month since the first
  month, x = sum(l_quantity).

Events are pre-aggregated per (entity, channel, step) map-side before any shuffle, so a hot
entity sends at most F*T partial rows per map task; gaps are filled by `dense_cells`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope.functions.once import once
from chronoscope.sources.tables import read_table

def cells_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and NaN entries count as 0."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = emb.select(F.col("vec_id").cast("bigint").alias("noun_id"), F.posexplode("embedding").alias("t", "x"))
    return cells.select("noun_id", F.lit(0).cast("bigint").alias("feature"), F.col("t").cast("bigint"),
                        F.coalesce(F.nanvl(F.col("x").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("x"))


def targets_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return emb.select(F.col("vec_id").cast("bigint").alias("noun_id"), F.col("label").cast("string").alias("target"))


def rows_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(noun_id, signal [step][feature], labels) of each vector: one row per sample, as stored."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return emb.select(F.col("vec_id").cast("bigint").alias("noun_id"), F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("signal"),
                      F.array_compact(F.array(F.col("label").cast("string"))).alias("labels"))


def rows_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(noun_id, signal [step][feature], labels): a user's days from the first to the last with an event, so
    signals differ in length; one feature per event type, NaN where a day has none of it; labels: the types
    of the user's last day. A user has at most days x types bins, which are summed before the shuffle."""
    bins = _event_bins(spark, sf_dir, keep_nan=True).where(F.col("channel").isNotNull() & F.col("step").isNotNull())
    names = bins.select(F.array_sort(F.collect_set("channel"))).scalar()  # one name per channel
    placed = bins.withColumn("_names", names).withColumn("_F", F.size("_names"))
    k = F.col("step") * F.col("_F") + F.array_position("_names", F.col("channel")).cast("int") - 1
    users = placed.groupBy("noun_id").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), "v"))).alias("_bins"), F.min("step").alias("_first"), F.max("step").alias("_last"), F.first("_names").alias("_names"))
    n, nan = F.size("_names"), F.lit(float("nan"))
    after = F.concat(F.transform(F.slice("_bins", F.lit(2), F.size("_bins")), lambda b: b["k"]), F.array((F.col("_last") + 1) * n))
    filled = F.flatten(F.zip_with("_bins", after, lambda b, end: F.concat(F.array(b["v"]), F.array_repeat(nan, end - b["k"] - 1))))
    dense = F.concat(F.array_repeat(nan, F.get("_bins", F.lit(0))["k"] - F.col("_first") * n), filled)
    users = users.select("noun_id", dense.alias("_dense"), (F.col("_last") - F.col("_first")).alias("_days"), F.filter("_bins", lambda b: b["k"] >= F.col("_last") * n).alias("_today"), "_last", "_names")
    days = F.sequence(F.lit(0), F.col("_days"))
    return users.select("noun_id", once(F.col("_dense"), lambda dense: F.transform(days, lambda d: F.slice(dense, d * n + 1, n))).alias("signal"),
                        F.transform("_today", lambda b: F.get("_names", b["k"] - F.col("_last") * n)).alias("labels"))


def dense_cells(binned: DataFrame) -> DataFrame:
    """binned: (noun_id, channel, step, v), one row per bin -> cells (noun_id, feature, t, x) of all channels
    (sorted by name) x steps, counted from the first step in the table; bins without a row are 0, rows
    without a channel or a step are left out.

    A bin fills the places from its own to the next one of its entity, so the grid comes out of one window
    over the bins; it is not made apart and joined."""
    from chronoscope.session import materialize
    # the source is read once: origin, steps and channels come from the bins
    binned = materialize(binned.where(F.col("channel").isNotNull() & F.col("step").isNotNull()))
    whole = binned.select(F.min("step").alias("first"), (F.max("step") - F.min("step") + 1).alias("n_steps"), F.array_sort(F.collect_set("channel")).alias("names"))  # one row
    first, n_steps, names = (whole.select(c).scalar() for c in ("first", "n_steps", "names"))
    rows = binned.withColumn("_T", n_steps).withColumn("_names", names).select(
        "noun_id", "v", "_T", (F.size("_names") * F.col("_T")).cast("bigint").alias("_size"),
        ((F.array_position("_names", F.col("channel")) - 1) * F.col("_T") + F.col("step") - first).cast("bigint").alias("_k"))
    w = Window.partitionBy("noun_id").orderBy("_k")
    start = F.when(F.row_number().over(w) == 1, F.lit(0).cast("bigint")).otherwise(F.col("_k"))
    runs = rows.select("noun_id", "v", "_k", "_T", start.alias("_from"), (F.coalesce(F.lead("_k").over(w), F.col("_size")) - 1).alias("_to"))
    places = runs.select("noun_id", "v", "_k", "_T", F.explode(F.sequence("_from", "_to")).alias("_at"))
    return places.select("noun_id", F.floor(F.col("_at") / F.col("_T")).cast("bigint").alias("feature"), (F.col("_at") % F.col("_T")).cast("bigint").alias("t"),
                         F.when(F.col("_at") == F.col("_k"), F.col("v")).otherwise(F.lit(0.0)).alias("x"))


def _event_bins(spark: SparkSession, sf_dir: str, keep_nan: bool = False) -> DataFrame:
    """(noun_id, channel, step, v) by absolute day, reduced map-side before the shuffle."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    value = F.col("value") if keep_nan else F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return ev.select(F.col("user_id").cast("bigint").alias("noun_id"), F.col("event_type").alias("channel"), day.alias("step"), value.alias("v")).groupBy("noun_id", "channel", "step").agg(F.sum("v").alias("v"))


def cells_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_cells(_event_bins(spark, sf_dir))


def _lineitem_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(noun_id, flag, step, q) of every line item, by absolute month."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return li.select(F.col("l_suppkey").cast("bigint").alias("noun_id"), F.col("l_returnflag").alias("flag"), month.alias("step"),
                     F.coalesce(F.nanvl(F.col("l_quantity").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("q"))


def cells_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_cells(_lineitem_months(spark, sf_dir).groupBy("noun_id", F.col("flag").alias("channel"), "step").agg(F.sum("q").alias("v")))


def label_rule(value: Column, thresholds: Column) -> Column:
    """class = first i with value <= thresholds[i]; none -> last class (0-based)."""
    pos = F.array_position(F.transform(thresholds, lambda th: value <= th), True)
    return F.when(pos > 0, pos - 1).otherwise(F.size(thresholds) - 1)


def targets_by_quantile(cells: DataFrame, quantiles=(0.5, 1.0)) -> DataFrame:
    """Label each entity by the quantile class of its total (D4 + I16)."""
    from chronoscope.functions.ranking import exact_quantiles
    from chronoscope.session import materialize
    # summed once: a second sum in another order could move an entity across a threshold it defines
    totals = materialize(cells.groupBy("noun_id").agg(F.sum("x").alias("total")))
    thr = F.array(*[F.lit(v) for v in exact_quantiles(totals, "total", quantiles)])  # one value per entity: distributed
    return totals.withColumn("_thr", thr).select(
        "noun_id", label_rule(F.col("total"), F.col("_thr")).cast("string").alias("target"))


def signal_set(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(cells, targets) for one of: emb, evt, sup, tot (events, summed over either half of the days)."""
    if name == "emb":
        return cells_from_embeddings(spark, sf_dir), targets_from_embeddings(spark, sf_dir)
    if name == "evt":
        c = cells_from_events(spark, sf_dir)
        return c, targets_by_quantile(c)
    if name == "sup":
        c = cells_from_lineitem(spark, sf_dir)
        return c, targets_by_quantile(c)
    if name == "tot":
        c = halves(cells_from_events(spark, sf_dir))
        return c, targets_by_quantile(c)
    raise ValueError(f"unknown signal set {name!r}")


def halves(cells: DataFrame) -> DataFrame:
    """The cells with their steps summed into two: few enough that every coalition of cells can be tried."""
    n_steps = cells.select(F.max("t") + 1).scalar()
    return cells.withColumn("_T", n_steps).groupBy("noun_id", "feature", F.floor(F.col("t") * 2 / F.col("_T")).cast("bigint").alias("t")).agg(F.sum("x").alias("x"))


def cells_to_tensor(cells: DataFrame) -> DataFrame:
    """(noun_id, signal array<array<double>> [time][feature]); one row per sample, bounded by T*F."""
    per_t = cells.groupBy("noun_id", "t").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("feature", "x"))), lambda s: s["x"]).alias("_row"))
    return per_t.groupBy("noun_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("t", "_row"))), lambda s: s["_row"]).alias("signal"))


def tensor_to_cells(tensor: DataFrame) -> DataFrame:
    """Inverse of cells_to_tensor: two posexplodes."""
    rows = tensor.select("noun_id", F.posexplode("signal").alias("t", "_row"))
    return rows.select("noun_id", F.col("t").cast("bigint"), F.posexplode("_row").alias("feature", "x")).select(
        "noun_id", F.col("feature").cast("bigint"), "t", "x")


def entity_cells_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(noun_id = supplier, entity = return flag index, feature (0 = quantity, 1 = line count), t = month, x):
    one signal per (supplier, flag) entity, dense over all months."""
    binned = _lineitem_months(spark, sf_dir).where(F.col("flag").isNotNull()).groupBy("noun_id", "flag", "step").agg(F.sum("q").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    both = F.explode(F.array(*[F.struct(F.concat_ws("#", "flag", F.lit(str(i))).alias("channel"), F.col(c).alias("v")) for i, c in enumerate(("q", "n"))]))
    dense = dense_cells(binned.select("noun_id", "step", both.alias("b")).select("noun_id", "b.channel", "step", "b.v"))
    # channel index k = 2 * flag_index + value index (channels sort as flag#0, flag#1)
    return dense.select("noun_id", (F.col("feature") / 2).cast("bigint").alias("entity"),
                        (F.col("feature") % 2).cast("bigint").alias("feature"), "t", "x")


# --- A1 / A12: reading stored signals, id lists -------------------------------------------------------------

def read_signals(spark: SparkSession, path: str, fields: list[str] | None = None, predicate=None, epochs: int = 1) -> DataFrame:
    """Stored signal rows: the named fields of the rows that meet the predicate (both reach the scan),
    each once per epoch, with the epoch as a column if there are several."""
    rows = spark.read.parquet(path)
    if predicate is not None:
        rows = rows.where(predicate)
    if fields is not None:
        rows = rows.select(*fields)
    return rows if epochs == 1 else rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def write_id_lists(split: DataFrame, path: str) -> None:
    """split (noun_id, split): one folder of id files per split."""
    split.select("noun_id", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_id_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The ids of one split; reads its folder only."""
    return spark.read.parquet(path).where(F.col("split") == name).select("noun_id")


# --- B5: one sample by its id -------------------------------------------------------------------------------

def store_for_lookup(rows: DataFrame, name: str = "lookup") -> DataFrame:
    """The rows as a table bucketed and sorted by noun_id: a lookup reads one bucket, and in it the row groups
    whose range holds the id."""
    from chronoscope.session import materialize_bucketed
    return materialize_bucketed(rows, "noun_id", name)


def point_lookup(stored: DataFrame, noun_id: int) -> DataFrame:
    """The rows of one sample (bucket pruning needs the id as a literal)."""
    return stored.where(F.col("noun_id") == F.lit(noun_id).cast("bigint"))
