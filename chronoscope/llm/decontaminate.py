"""Benchmark decontamination. DataFrame operations only.

Texts are compared as lower-case words (runs of letters and digits). A document holds an item if some
window of as many words as the item is similar to it: weighted Jaccard similarity of their runs of five
words (with counts) of at least 0.8. A run of the item weighs 1 / (number of items that have it), any
other run 1. An item of fewer than five words is one run.

1. A similar window shares a run with its item, at the place it has in the item or a few words off. So
   the runs of all documents are joined with those of the items, and each hit proposes a window of the
   item's size around it. This loses nothing that could pass the last step.
2. Each proposed window and each item gets a SimHash of 64 bits of its runs, which vote with their weights. Eight blocks of eight bits
   are indexed with all values within two flips, which by the pigeonhole principle finds every pair of
   fingerprints within a Hamming distance of 23.
3. What is left is verified by the exact similarity of the runs' texts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

RUN = 5
SIMILAR = 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: items' runs are broadcast up to so many, else joined by a shuffle
BROADCAST_RUNS = 1_000_000
NEIGHBOURS = sorted(sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n))


def words_of(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " ", -1))


def run_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; empty if there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(places, lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def run_texts(words: Column) -> Column:
    """Texts of all runs of RUN words, or of all words if there are fewer."""
    return F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(1), F.size(words) - RUN + 1), lambda i: F.array_join(F.slice(words, i, RUN), " "))).otherwise(F.array(F.array_join(words, " ")))


def simhash(runs: Column, weights: Column) -> Column:
    """64 bits; bit b is the weighted majority of bit b of the runs' hashes."""
    hashes = F.zip_with(runs, weights, lambda r, w: F.struct(F.xxhash64(r).alias("h"), w.alias("w")))
    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0.0), lambda n, x: n + (F.getbit(x["h"], b).cast("int") * 2 - 1) * x["w"])
        return F.when(votes > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda n, x: F.shiftleft(n, 1).bitwiseOR(x))


def blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("bigint")).alias("value")) for b in range(BLOCKS)])


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, n_words, runs, weights (of the runs), fingerprint. An item id that
    comes more than once keeps each of its texts."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words")).distinct()
    items = items.where(F.size("words") > 0).withColumn("runs", run_texts(F.col("words")))
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    shared = items.select("item", F.explode(F.array_distinct("runs")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("items"))
    weights = (items.select("item", F.posexplode("runs").alias("at", "run")).join(shared, "run")
               .groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", (1.0 / F.col("items")).alias("w")))).alias("x"))
               .select("item", F.col("x.w").alias("weights")))
    return items.join(weights, "item").withColumn("n_words", F.size("words")).withColumn("fingerprint", simhash(F.col("runs"), F.col("weights")))


def weights_in(window: Column, runs: Column, weights: Column) -> Column:
    """Weights of a window's runs: that of the item's equal run, else 1."""
    return F.transform(window, lambda r: F.when(F.array_contains(runs, r), F.element_at(weights, F.array_position(runs, r).cast("int"))).otherwise(F.lit(1.0)))


def similarity(window: Column, runs: Column, weights: Column) -> Column:
    """Weighted Jaccard similarity of two lists of runs with counts; weights belong to `runs`."""
    def count(of: Column, run: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == run)).cast("double")

    kinds = F.array_distinct(runs)
    def weight(run: Column) -> Column:
        return F.element_at(weights, F.array_position(runs, run).cast("int"))

    common = F.aggregate(kinds, F.lit(0.0), lambda n, r: n + weight(r) * F.least(count(runs, r), count(window, r)))
    own = F.aggregate(kinds, F.lit(0.0), lambda n, r: n + weight(r) * count(runs, r))
    theirs = F.aggregate(window, F.lit(0.0), lambda n, r: n + F.when(F.array_contains(runs, r), weight(r)).otherwise(F.lit(1.0)))
    return common / (own + theirs - common)


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, similarity of the best window and its
    first word. Null, empty and wordless texts hold nothing, nor do items without words. Rows that
    repeat an id give one row per item, with the best of their texts; a null id is an id like others. A
    document shorter than the item is compared as a whole. Other columns are ignored."""
    items = stored(benchmark_index(benchmark), "benchmark-items")
    lengths = [r["n"] for r in items.select(F.least("n_words", F.lit(RUN)).alias("n")).distinct().collect()]
    item_runs = items.select("item", "n_words", F.least("n_words", F.lit(RUN)).alias("k"), F.posexplode(F.expr("transform(runs, r -> r)")).alias("at", "run"), "words")
    item_runs = item_runs.select("item", "n_words", "k", "at", F.slice("words", F.col("at") + 1, F.col("k")).alias("w"))
    parts = [item_runs.where(F.col("k") == k).select("item", "n_words", "k", "at", F.xxhash64(*[F.col("w")[j] for j in range(k)]).alias("h")) for k in sorted(lengths)]
    if not parts:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word"))
    index = parts[0]
    for p in parts[1:]:
        index = index.unionByName(p)
    index = stored(index, "benchmark-runs")
    if index.count() <= BROADCAST_RUNS:
        index = F.broadcast(index)

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("ver"))
    runs = texts.select("doc_id", "ver", words_of(F.col("text")).alias("words"))
    tagged = [F.struct(F.lit(k).alias("k"), run_hashes(F.col("words"), k).alias("hs")) for k in sorted(lengths)]
    hits = None
    for tag in tagged:
        one = runs.select("doc_id", "ver", tag.alias("t")).select("doc_id", "ver", F.col("t.k").alias("k"), F.posexplode("t.hs").alias("pos", "h"))
        one = one.join(index, ["k", "h"]).select("doc_id", "ver", "item", "n_words", (F.col("pos") - F.col("at")).alias("start"))
        hits = one if hits is None else hits.unionByName(one)
    proposed = stored(hits.groupBy("doc_id", "ver").agg(F.collect_set(F.struct("item", "start", "n_words")).alias("proposed")), "benchmark-hits")

    wide = texts.join(proposed.withColumnRenamed("doc_id", "d").withColumnRenamed("ver", "v"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("ver") == F.col("v")))
    wide = wide.select("doc_id", words_of(F.col("text")).alias("words"), "proposed").select("doc_id", "words", F.explode("proposed").alias("p"))
    first = F.greatest(F.lit(0), F.least(F.col("p.start"), F.size("words") - F.col("p.n_words")))
    windows = wide.select("doc_id", F.col("p.item").alias("item"), first.alias("first_word"), F.slice("words", first + 1, F.col("p.n_words")).alias("window"))
    windows = windows.distinct().withColumn("runs", run_texts(F.col("window"))).drop("window")
    windows = windows.join(items.select("item", F.col("runs").alias("item_runs"), "weights"), "item")
    windows = windows.withColumn("fp", simhash(F.col("runs"), weights_in(F.col("runs"), F.col("item_runs"), F.col("weights")))).withColumn("b", F.explode(blocks(F.col("fp")))).select("doc_id", "item", "first_word", "runs", "fp", "b.block", "b.value")

    near = F.explode(F.array(*[F.lit(n).cast("bigint") for n in NEIGHBOURS]))
    table = items.select("item", "item_id", F.col("runs").alias("item_runs"), "weights", "fingerprint")
    keys = items.select("item", F.explode(blocks(F.col("fingerprint"))).alias("b"), "fingerprint").select("item", "b.block", "b.value", "fingerprint").withColumn("flip", near)
    keys = keys.select("item", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "fingerprint")
    found = windows.join(keys, ["item", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fingerprint"))) <= RADIUS)
    found = found.groupBy("doc_id", "item", "first_word").agg(F.first("runs").alias("runs"))
    verified = found.join(table, "item").withColumn("similarity", similarity(F.col("runs"), F.col("item_runs"), F.col("weights"))).where(F.col("similarity") >= similar - 1e-9)
    return (verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("f"))).alias("best"))
            .select("doc_id", "item_id", F.round("best.similarity", 9).alias("similarity"), (-F.col("best.f")).cast("long").alias("first_word")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose id holds no benchmark item; rows with a null id are kept or dropped alike."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("d")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
