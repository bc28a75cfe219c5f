"""Spelling variants: words that one inserted, deleted or replaced letter tells apart.

Two words are near if the longer one has m letters and the common prefix and the common suffix have m - 1
together (exactly: reach m - 1, the words being different). Words are laid out as padded matrices of code
points, tile by tile, and the prefix and suffix lengths of all pairs of a tile are found at once.

Which words meet in a tile: for a near pair, prefix + suffix >= m - 1, so the prefix or the suffix has
half = ceil((m - 1) / 2) letters at least. A tile therefore holds the words of m and of m - 1 letters with one
and the same prefix (or suffix) of `half` letters. A tile of more than TILE words is cut by the same rule
again: what is left of the words beyond the shared letters differs by one edit too, so its first or its last
half is shared. Each cut halves what may differ, down to one or two letters, so the number of tiles that a
word can be in is bounded by its length and no pair is lost. A pair that meets in several tiles counts in one:
the tile of a prefix is taken before that of a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
OUTWEIGHS = 10
SLIP = 31
TILE = 256
PAIRS_AT_ONCE = 1 << 16
CELLS_AT_ONCE = 1 << 21


# --- words -----------------------------------------------------------------------------------------------------

def with_slips(doc_id: Column, run: Column, every: int) -> Column:
    """The run, less one letter where `every` divides the crc32 of `<doc_id>:<run>`: letter crc32 % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = SLIP) -> DataFrame:
    """word, n: the runs of letters in the texts, A-Z lower-cased, with at least `least_length` code points
    and `least_count` occurrences. With `every`, single letters are dropped as `with_slips` says. Counts are
    summed before the shuffle, so a frequent word costs a task one row."""
    # a shorter run can hold no match, and a match takes its whole run
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(runs).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    words = found.select((with_slips(F.col("doc_id"), run, every) if every else run).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# --- tiles -----------------------------------------------------------------------------------------------------

TILE_ID = ["m", "head", "tail", "below", "key"]


def first_tiles(words: DataFrame) -> DataFrame:
    """word, n and the tiles of every word: by prefix and by suffix, as the longer word (m letters) and as the
    shorter one (m - 1). head, tail: how many letters at either end are shared; below: pairs whose common
    prefix has as many letters or more are counted in another tile."""
    length = F.length("word")
    as_both = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    start = as_both.select("word", "n", "m", F.lit(0).alias("head"), F.lit(0).alias("tail"), (F.col("m") + 1).alias("below"))
    return finer_tiles(start)


def finer_tiles(rows: DataFrame) -> DataFrame:
    """The same words, their tiles cut in two kinds: half of the letters that are to be shared and are not
    yet joins the head, or the tail. The key is a hash of the shared letters (tiles whose hashes collide are
    compared as one, which costs time only)."""
    half = F.ceil((F.col("m") - 1 - F.col("head") - F.col("tail")) / 2).cast("int")
    longer_head, longer_tail = F.col("head") + half, F.col("tail") + half
    cuts = F.array(F.struct(longer_head.alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below")),
                   F.struct(F.col("head").alias("head"), longer_tail.alias("tail"), F.least("below", longer_head).alias("below")))
    cut = rows.select("word", "n", "m", F.explode(cuts).alias("s")).select("word", "n", "m", "s.head", "s.tail", "s.below")
    shared = F.concat(F.expr("left(word, head)"), F.lit("\n"), F.expr("right(word, tail)"))
    return cut.withColumn("key", F.xxhash64("m", "head", "tail", shared))


def tiles(words: DataFrame, most: int = TILE) -> DataFrame:
    """word, n, m, head, tail, below, key: rows of tiles with two words or more. A tile of more than `most`
    words (or of more letters than fit in one matrix) is cut until all but one letter are shared."""
    rows, done = first_tiles(words), None
    while True:
        rows = stored(rows, "spelling-tiles")
        sizes = rows.groupBy(*TILE_ID).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        large = ((F.col("size") > most) | (F.col("size") * F.col("m") > CELLS_AT_ONCE)) & (F.col("head") + F.col("tail") < F.col("m") - 1)
        sizes = stored(sizes.select(*TILE_ID, large.alias("large")), "spelling-sizes")
        fitting = rows.join(sizes.where(~F.col("large")), TILE_ID, "left_semi")
        done = fitting if done is None else done.unionByName(fitting)
        if not sizes.where("large").limit(1).count():
            return done
        rows = finer_tiles(rows.join(sizes.where("large"), TILE_ID, "left_semi"))


# --- comparison ------------------------------------------------------------------------------------------------

def code_points(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, padded with zeros."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that each row of a shares with the same row of b before the first difference."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_pairs(words: list[str], m: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs words[left[i]], words[right[i]] (of m or m - 1 letters, not both m - 1) are near; and
    the length of their common prefix."""
    lengths = np.array([len(w) for w in words])
    forward = code_points(words, m)
    backward = code_points([w[::-1] for w in words], m)
    near, heads = np.zeros(len(left), bool), np.zeros(len(left), np.int64)
    step = max(1, CELLS_AT_ONCE // m)
    for at in range(0, len(left), step):
        i, j = left[at:at + step], right[at:at + step]
        shorter = np.minimum(lengths[i], lengths[j])
        head = np.minimum(common_lengths(forward[i], forward[j]), shorter)
        tail = np.minimum(common_lengths(backward[i], backward[j]), shorter)
        near[at:at + step] = (np.maximum(lengths[i], lengths[j]) == m) & (head < m) & (head + tail >= m - 1)
        heads[at:at + step] = head
    return near, heads


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside consecutive tiles of these sizes."""
    left, right, start = [], [], 0
    for size in sizes.tolist():
        i, j = np.triu_indices(size, 1)
        left.append(i + start)
        right.append(j + start)
        start += size
    return np.concatenate(left), np.concatenate(right)


def compared(rows: DataFrame) -> DataFrame:
    """word, n, other, other_n: the near pairs of the tiles, in both directions, each once."""
    def found(words, counts, m, below, sizes):
        left, right = _pairs_of(np.array(sizes))
        near, heads = near_pairs(words, m, left, right)
        at = np.flatnonzero(near & (heads < below))
        x, y = np.concatenate([left[at], right[at]]), np.concatenate([right[at], left[at]])
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in x], pa.string()), pa.array([counts[k] for k in x], pa.int64()),
                                           pa.array([words[k] for k in y], pa.string()), pa.array([counts[k] for k in y], pa.int64())], names=["word", "n", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, shape, words, counts, sizes, held = None, None, [], [], [], 0
        for batch in batches:
            for m, head, tail, below, key, word, n in zip(*(batch.column(c).to_pylist() for c in [*TILE_ID, "word", "n"])):
                if (m, head, tail, below, key) != tile:
                    if words and ((m, below) != shape or held >= PAIRS_AT_ONCE or len(words) * m >= CELLS_AT_ONCE):
                        yield found(words, counts, *shape, sizes)
                        words, counts, sizes, held = [], [], [], 0
                    tile, shape = (m, head, tail, below, key), (m, below)
                    sizes.append(0)
                held += sizes[-1]  # pairs with the words of the tile so far
                sizes[-1] += 1
                words.append(word)
                counts.append(n)
        if words:
            yield found(words, counts, *shape, sizes)

    dealt = rows.repartition("key").sortWithinPartitions("m", "below", "head", "tail", "key")
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


# --- forms and roots -------------------------------------------------------------------------------------------

def roots(forms: DataFrame, most_n: int) -> DataFrame:
    """word, root of forms(word, form): the last word that the forms lead to. n grows by OUTWEIGHS with every
    step, so a path has at most log(most_n) steps, and each round doubles the steps taken."""
    steps = max(1, ceil(log10(max(2, most_n)) / log10(OUTWEIGHS)))
    rows = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = stored(rows.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return rows


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = SLIP, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that `word_counts` finds in `docs` (doc_id, text).

    n_near: how many other words one inserted, deleted or replaced code point makes of it (0 if none). form:
    the near word of largest n (ties: the first in code-point order) if that is at least OUTWEIGHS times the
    word's n, else null; form_n its n. root: where the forms lead from the word in the end; the word itself
    without a form. Null texts have no words, a null id reads as an empty one, repeated rows count each; other
    columns are ignored. An empty table, or one without such words, gives no rows.
    """
    words = stored(word_counts(docs, least_length, least_count, every), "spelling-words")
    pairs = compared(tiles(words, tile))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = words.join(best, "word", "left")
    outweighed = -F.col("best.less") >= OUTWEIGHS * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(outweighed, F.col("best.other")).alias("form"), F.when(outweighed, -F.col("best.less")).alias("form_n")), "spelling-forms")
    most_n = named.agg(F.max("n")).first()[0] or 0
    led = roots(named.where(F.col("form").isNotNull()), most_n)
    return named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
