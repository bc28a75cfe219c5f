"""URL verdicts from host and path rules by a sort-merge range join.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's; of the rules that fit, the longest (host and path together, then the longer host) decides.

Canonical key: the labels of the host reversed, `#`, then the path (`#` can stand in neither). A rule covers
the interval of keys that start with its own. A url is looked up once for each suffix of its host that is the
host of some rule, so every rule that fits is an interval around one of its keys. Intervals of this kind are
nested or disjoint: in key order a stack of the rules whose interval is open has the innermost on top.

Keys and rules are dealt to contiguous ranges of the key space. A rule goes to every range that its interval
meets, so a sweep starts with the rules that are open already. The cut points are keys too, of (key, hash of
the row), so rows with one and the same key are split over ranges as well.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .storage import broadcast_if_small, shuffle_partitions

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BARE = "#"
#: Ranges of the key space for each shuffle partition, and keys looked at for each cut point.
RANGES, LOOKED_AT = 2, 16
RULE_SCHEMA = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased) and path (from there up
    to `?`, `#` or the end). Without `://`, or null: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Cut points of about equal ranges: quantiles of the keys with the smallest row hashes (at most
    ranges * LOOKED_AT of them come to the driver). They only balance the ranges."""
    seen = keys.select("key", "tie").orderBy("tie", "key").limit(ranges * LOOKED_AT).collect()
    seen = sorted((r["key"], r["tie"]) for r in seen)
    return sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []


def _ranged(rows: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """The keys with the number of their range."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(cuts, x) for x in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*names, "part"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("part", IntegerType())]))


def _dealt_rules(rules: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """Each rule in every range that holds a key it covers: from the range of the first possible row of its
    key to that of the last key before its interval ends."""
    names = rules.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                # the first cut beyond the interval: no key that starts with `key` sorts after it
                low, high = bisect_left(cuts, key, key=lambda c: c[0]), bisect_left(cuts, True, key=lambda c, k=key: c[0] > k and not c[0].startswith(k))
                at += [i] * (high - low + 1)
                part += range(low, high + 1)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32())], names=[*names, "part"])

    return rules.mapInArrow(run, StructType([*rules.schema.fields, StructField("part", IntegerType())]))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, key, rules first: the innermost open rule of every looked-up key."""
    part, stack = None, []
    for batch in batches:
        at, best = [], []
        parts, keys, rules = (batch.column(c).to_pylist() for c in ("part", "key", "best"))
        for i, (p, key, rule) in enumerate(zip(parts, keys, rules)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule))
            elif stack:
                at.append(i)
                best.append(stack[-1][1])
        found = batch.column("id").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([found, pa.array(best, batch.column("best").type)], names=["id", "best"])


def canonical_rules(rules: DataFrame) -> DataFrame:
    """key, rhost, labels and best(length, host, rule, verdict) of rules(host, path, verdict). Null host or path counts as
    empty, hosts are lower-cased (A-Z); of rules with the same host and path the one that blocks counts.
    A rule without a host fits no url."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    one = rules.select(host.alias("host"), path.alias("path"), "verdict").where(F.col("host") != "").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rhost = reversed_host(F.col("host"))
    best = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host"), F.concat("host", "path").alias("rule"), "verdict")
    return one.select(F.concat(rhost, F.lit(BARE), "path").alias("key"), rhost.alias("rhost"), F.size(F.split("host", r"\.")).alias("labels"), best.alias("best"))


def judged(urls: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", default: str = ALLOW) -> DataFrame:
    """The columns `keep` of every row with host, path, rule (null if none fits) and verdict (the rule's,
    else `default`). rules: host, path, verdict ('allow' or 'block'; of equal rules 'block' counts).

    Null urls and urls without `://` have an empty host and path, so no rule fits them. Repeated rows (also
    with null ids) come back as often as they stand in the input; other columns are ignored, whatever their
    names. Empty tables: no rows, or all rows with `default`. Rules may be many: their hosts are broadcast
    only after a count (else all suffixes are looked up), and the rules themselves are shuffled by range.
    """
    spark = urls.sparkSession
    ids = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(url).alias("url"))
    host, path = url_parts(F.col("id.url"))
    rows = urls.select(ids.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("copies")).select("id", "copies", host.alias("host"), path.alias("path"))

    rules = canonical_rules(rules)
    hosts = rules.select("rhost", "labels").distinct()
    n, most = hosts.agg(F.count(F.lit(1)), F.max("labels")).first()
    labels = F.reverse(F.split("host", r"\."))
    depth = F.least(F.size(labels), F.lit(most or 0))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(labels, 1, k), "."))
    probes = rows.where((F.col("host") != "") & F.lit(n > 0)).select("id", "path", F.explode(F.when(depth > 0, suffixes)).alias("rhost"))
    small = broadcast_if_small(hosts.select("rhost"), n)
    if small is not hosts:
        probes = probes.join(small, "rhost", "left_semi")
    probes = probes.select("id", F.concat("rhost", F.lit(BARE), "path").alias("key"), F.xxhash64("id").alias("tie"))

    ranges = RANGES * shuffle_partitions(spark)
    cuts = _cuts(probes, ranges)
    no_rule, no_id = (F.lit(None).cast(t.schema[c].dataType).alias(c) for t, c in ((rules, "best"), (rows, "id")))
    events = _ranged(probes, cuts).select("part", "key", no_rule, "id")
    openings = _dealt_rules(rules, cuts).select("part", "key", "best", no_id)
    swept = events.unionByName(openings).repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", F.col("best").isNull())
    found = swept.mapInArrow(_sweep, StructType([StructField(c, events.schema[c].dataType) for c in ("id", "best")]))
    every = rows.select("id", no_rule, "copies").unionByName(found.withColumn("copies", F.lit(0).cast("long")))
    one = every.groupBy("id").agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))
    one = one.select("id", "best", F.explode(F.expr("sequence(1L, copies)")).alias("nth"))
    host, path = url_parts(F.col("id.url"))
    return one.select(*[F.col(f"id.c{i}").alias(c) for i, c in enumerate(keep)], host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
