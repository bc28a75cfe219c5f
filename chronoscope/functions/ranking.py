"""Exact global ranks without a single-partition window, and order statistics without a buffer for a group.

`row_number() over (order by h)` with no partition moves every row into one task.
Instead: bucket rows by the high bits of a uniform 60-bit hash, count rows per
bucket (a bounded table of `n_buckets` rows), turn the counts into offsets, and
rank inside each bucket. rank = offset[bucket] + row_number within bucket.
Buckets are equal-sized in expectation because the hash is uniform, and ids are
unique, so no bucket is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast

RANGES = 256
DEFAULT_BUCKET_BITS = 12  # 4,096 buckets; the offsets table is broadcast (bounded by 2**bits rows)


def global_rank(df: DataFrame, order_col: str, tie_cols: list[str], rank_col: str = "rank",
                bucket_bits: int = DEFAULT_BUCKET_BITS, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Add a 1-based position by (order_col, *tie_cols) within each group of `group_cols` (few,
    bounded groups such as epochs); order_col is a uniform 60-bit hash."""
    g = list(group_cols)
    b = df.withColumn("_bucket", F.shiftright(F.col(order_col), 60 - bucket_bits))
    counts = b.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # counts has at most groups x 2**bucket_bits rows
    offsets = counts.select(
        *g, "_bucket",
        (F.sum("_n").over(Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    w = Window.partitionBy(*g, "_bucket").orderBy(F.col(order_col), *[F.col(c) for c in tie_cols])
    ranked = b.withColumn("_rn", F.row_number().over(w))
    side = bounded_broadcast(offsets) if g else F.broadcast(offsets)  # 2**bits rows for each group
    return (
        ranked.join(side, [*g, "_bucket"])
        .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_bucket", "_rn", "_off")
    )


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition `df` on `cols` into spark.sql.shuffle.partitions parts before a stage that
    expands every row (grid points x attempts x permutations). A numbered repartition is not
    coalesced by AQE, so the expansion keeps its parallelism even when its input is small;
    only the pre-expansion rows cross the shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def exact_quantiles(df: DataFrame, col: str, qs) -> list[float | None]:
    """Linearly interpolated quantiles (numpy's default rule) of a column of any size.

    `percentile` would keep all values of a group in one aggregation buffer. Here the values are
    materialised once, range bounds are taken from approximate quantiles (their number is RANGES), the
    values of each range are counted, and only the ranges that hold a wanted position are sorted, each
    by itself, for the <= 2 values around it. The bounds decide about the work, not about the result."""
    import math
    from chronoscope.session import materialize
    vals = materialize(df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    cuts = vals.select(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("c")).first()["c"]
    if not cuts:
        return [None for _ in qs]
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_v")))
    dealt = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_k")).withColumn("_p", part)  # equal values: one row
    counts = {r["_p"]: r["_n"] for r in dealt.groupBy("_p").agg(F.sum("_k").alias("_n")).collect()}
    before, n = {}, 0
    for p in sorted(counts):
        before[p] = n
        n += counts[p]
    want = {float(q): (math.floor(float(q) * (n - 1)), math.ceil(float(q) * (n - 1))) for q in qs}
    ranks = sorted({r for pair in want.values() for r in pair})
    holding = {p for p in counts for r in ranks if before[p] <= r < before[p] + counts[p]}
    below = F.create_map(*[F.lit(x) for p in holding for x in (p, before[p])])
    upto = F.sum("_k").over(Window.partitionBy("_p").orderBy("_v")) + below[F.col("_p")]
    placed = dealt.where(F.col("_p").isin(sorted(holding))).select("_v", "_k", upto.alias("_e"))
    hit = F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("_e")) & (r >= F.col("_e") - F.col("_k")))
    rows = placed.where(hit).collect()  # at most two values per quantile
    at = {r: next(x["_v"] for x in rows if x["_e"] - x["_k"] <= r < x["_e"]) for r in ranks}
    return [at[lo] + (float(q) * (n - 1) - lo) * (at[hi] - at[lo]) for q, (lo, hi) in ((q, want[float(q)]) for q in qs)]


# --- order statistics of many groups ------------------------------------------------------------------------------

SORTED_ROWS = 1 << 18


def grouped_order_stats(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """(keys..., at): `at` maps each wanted 0-based position to the value there among the group's sorted
    values (nulls left out). wanted: (keys..., n, want): the group's number of values and its positions (an
    array, few).

    No group is held in a buffer. Groups of up to `sorted_rows` values are numbered by a window, whose sort
    spills. A larger group is cut into RANGES ranges of equal width between its least and greatest value,
    which are counted; only ranges that hold a wanted position are cut further, until they have at most
    `sorted_rows` values or one value only, and only those are read and sorted, each by itself."""
    from chronoscope.session import materialize
    v = F.col(value).cast("double")
    vals = rows.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    large = materialize(wanted.where(F.col("n") > sorted_rows).select(*keys, "want"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    small = wanted.where(F.col("n") <= sorted_rows).select(*keys, "want")
    some_large = bool(large.limit(1).count())
    numbered = (vals.join(bounded_broadcast(large.select(*keys)), keys, "left_anti") if some_large else vals).withColumn("_p", place.cast("bigint"))
    hits = numbered.join(small, keys).where(F.array_contains("want", F.col("_p"))).select(*keys, "_p", "_v")
    if some_large:
        hits = hits.unionByName(_positions_of_large(vals.join(bounded_broadcast(large.select(*keys)), keys, "left_semi"), keys, large, sorted_rows))
    return hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("at"))


def _positions_of_large(vals: DataFrame, keys: list[str], large: DataFrame, sorted_rows: int) -> DataFrame:
    """(keys..., _p, _v) of the wanted positions of large groups. A range is (low, high, first, size): its
    least and greatest value, the position of its first value and how many it has."""
    from chronoscope.session import materialize
    vals = materialize(vals)
    whole = vals.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.lit(0).cast("bigint").alias("first"), F.count(F.lit(1)).alias("size"))
    ranges = materialize(whole)
    to_cut = (F.col("size") > sorted_rows) & (F.col("low") < F.col("high"))
    done = ranges.where(~to_cut)
    while ranges.where(to_cut).limit(1).count():
        part = F.floor((F.col("_v") - F.col("r.low")) / (F.col("r.high") - F.col("r.low")) * RANGES)
        cut = _in_range(vals, keys, ranges.where(to_cut)).groupBy(*keys, F.col("r.first").alias("_start"), F.least(part, F.lit(RANGES - 1)).alias("_part")).agg(
            F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys, "_start").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        finer = cut.select(*keys, "low", "high", (F.col("_start") + before).alias("first"), "size").join(bounded_broadcast(large), keys)
        holds = F.exists("want", lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("size")))
        ranges = materialize(finer.where(holds).drop("want"))
        done = done.unionByName(ranges.where(~to_cut))
    done = materialize(done)
    constant = done.where(F.col("low") == F.col("high")).join(bounded_broadcast(large), keys)
    inside = F.filter("want", lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("size")))
    known = constant.select(*keys, F.explode(inside).alias("_p"), F.col("low").alias("_v"))
    place = F.row_number().over(Window.partitionBy(*keys, "r.first").orderBy("_v")) - 1 + F.col("r.first")
    placed = _in_range(vals, keys, done.where(F.col("low") < F.col("high"))).withColumn("_p", place.cast("bigint"))
    return placed.join(bounded_broadcast(large), keys).where(F.array_contains("want", F.col("_p"))).select(*keys, "_p", "_v").unionByName(known)


def _in_range(vals: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """vals with the range `r` of their group that they lie in; others are left out. Ranges of a group are
    disjoint and few (at most one for each wanted position)."""
    listed = ranges.groupBy(*keys).agg(F.collect_list(F.struct("low", "high", "first", "size")).alias("_ranges"))
    own = F.get(F.filter("_ranges", lambda r: (F.col("_v") >= r["low"]) & (F.col("_v") <= r["high"])), F.lit(0))
    return vals.join(bounded_broadcast(listed), keys).select(*keys, "_v", own.alias("r")).where(F.col("r").isNotNull())


def interpolated(at: Column, position: Column) -> Column:
    """The value at a position that may lie between two (both are in `at`), as numpy's default rule."""
    low, high = F.floor(position), F.ceil(position)
    a, b = F.element_at(at, low), F.element_at(at, high)
    return F.when(low == high, a).otherwise((high - position) * a + (position - low) * b)
