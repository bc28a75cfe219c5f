"""Document fingerprints: SimHash over weighted word shingles, and a search by permuted block tables.

Terms are runs of three consecutive words (all words of a shorter text); a term weighs its bytes
without separators, capped at 255, once per occurrence. Each term hash votes with its weight for or against each
of 128 bits; the signs of the sums are the fingerprint (32 hex digits). The angle between two texts'
term vectors is estimated from the Hamming distance h, and the likeness is cos(pi * h / 128), not
below 0: 1 for equal fingerprints, about 0 for texts that share no term.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import shuffle_partitions
from .textbatch import Texts, mix64, text_parts

BITS = 128
TERM_WORDS = 3
SECOND = np.uint64(0xD6E8FEB86659FD93)
#: terms whose votes are summed in 16-bit counters before they go to wide ones (256 * 255 < 2**16)
VOTE_BLOCK = 256
TERMS_AT_ONCE = 1 << 16
#: range bounds are compared one by one, so their number is held; a part is streamed, whatever its size
MOST_PARTS = 2000
#: several parts a task, so that tasks come out even though the parts are dealt by a hash
PARTS_PER_TASK = 6


def _term_weights(texts: Texts, k: int) -> np.ndarray:
    """Bytes of the words of each term, capped at 255; in the order of Texts.shingles(k)."""
    length = (texts.ends - texts.starts).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    offs, n = texts.word_offsets, texts.n_words
    first = np.concatenate([np.arange(a, max(b - k + 1, a + (b > a))) for a, b in zip(offs[:-1], offs[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.searchsorted(offs, first, side="right") - 1
    last = np.minimum(first + k, offs[doc + 1]) if len(n) else first
    return np.minimum(total[last] - total[first], 255)


def fingerprints(texts: Texts) -> np.ndarray:
    """(documents, BITS / 8) bytes."""
    terms, offs = texts.shingles(TERM_WORDS)
    weights = _term_weights(texts, TERM_WORDS).astype(np.uint16)
    votes = np.zeros((len(texts), BITS), np.int64)
    weight_sum = np.zeros(len(texts), np.int64)
    for start in range(0, len(terms), TERMS_AT_ONCE):
        stop = min(start + TERMS_AT_ONCE, len(terms))
        part = terms[start:stop]
        both = np.stack([part, mix64(part ^ SECOND)], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        weighted = bits * weights[start:stop, None]
        cuts = np.unique(np.concatenate([np.arange(0, len(part), VOTE_BLOCK), np.clip(offs[:-1] - start, 0, len(part))]))
        cuts = cuts[cuts < len(part)]
        sums = np.add.reduceat(weighted, cuts, axis=0, dtype=np.uint16)
        doc = np.searchsorted(offs, cuts + start, side="right") - 1
        np.add.at(votes, doc, sums.astype(np.int64))
        np.add.at(weight_sum, doc, np.add.reduceat(weights[start:stop].astype(np.int64), cuts))
    return np.packbits(2 * votes > weight_sum[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of two texts' term vectors, 0 to 1, from fingerprint bytes (rows)."""
    distance = np.unpackbits(a ^ b, axis=-1).sum(axis=-1)
    return np.where(distance == 0, 1.0, np.maximum(0.0, np.cos(math.pi * distance / BITS)))


def _texts_of(strings: list[str]) -> Texts:
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(raw), np.uint8), offsets)


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fingerprint` (32 hex digits; null text counts as empty) to every row. No shuffle."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "fingerprint"], T.StructField("fingerprint", T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_parts(batch.column(text)):
                out = [bytes(x).hex() for x in fingerprints(texts)]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    return docs.mapInArrow(run, schema)


def with_successor_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows in ascending order of `key`, range-partitioned, such that each partition also ends with the
    first row of the next one (the last partition: with the first row of all), marked guest = true.
    Then a pass over one partition sees every row's successor. One shuffle of the rows; the range
    bounds (PARTS_PER_TASK times the shuffle partitions) and the first keys are all that reaches the driver."""
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    parts = min(PARTS_PER_TASK * tasks, MOST_PARTS)
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))), F.lit(0))
    dealt = docs.withColumn("part", F.when(F.col(key).isNull(), F.lit(0)).otherwise(part))
    order = F.struct(F.col(key).isNotNull(), F.col(key), F.xxhash64("text"))
    heads = {r["part"]: r["h"] for r in dealt.groupBy("part").agg(F.min(order).alias("h")).collect()}
    filled = sorted(heads)
    rows = dealt.withColumn("guest", F.lit(False))
    if filled:
        before = {p: filled[i - 1] for i, p in enumerate(filled)}
        head = F.create_map(*[F.lit(x) for p in filled for x in (p, before[p])])
        is_head = F.lit(False)
        keys = [heads[p][1] for p in filled if heads[p][1] is not None]
        null_part = [p for p in filled if heads[p][1] is None]
        if keys:
            is_head = F.coalesce(F.col(key).isin(keys), F.lit(False))
        if null_part:
            is_head = is_head | F.col(key).isNull()
        hashes = F.create_map(*[F.lit(x) for p in filled for x in (p, heads[p][2])])
        is_head = is_head & (F.xxhash64("text") == hashes[F.col("part")])
        guests = dealt.where(is_head).withColumn("part", head[F.col("part")]).withColumn("guest", F.lit(True))
        rows = rows.unionByName(guests)
    return (rows.repartition(tasks, "part")
            .sortWithinPartitions("part", "guest", F.col(key).isNotNull(), key, F.xxhash64("text")))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text (null: empty), of its edited text (the last half of its code points
    replaced by the first as many of the next document by ascending doc_id, the last one's next being
    the first), the likeness of the two, and of the text and the next document's text.

    Repeated rows and ties of doc_id stand next to each other, ordered by a hash of the text; a null
    doc_id comes first. Copies of a whole row count as one place in the order and each gets a result.
    An empty table gives an empty result; other columns are ignored."""
    ordered = with_successor_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the part that has not met its successor yet
        for batch in batches:
            for start, stop, texts in text_parts(batch.column("text")):
                rows = batch.slice(start, stop - start)
                ids, part, guest = (rows.column(c).to_pylist() for c in ("doc_id", "part", "guest"))
                strings = rows.column("text").to_pylist()
                prints = fingerprints(texts)
                if held:
                    ids, part, guest, strings = [held[0], *ids], [held[1], *part], [held[2], *guest], [held[3], *strings]
                    prints = np.concatenate([held[4], prints])
                held = (ids[-1], part[-1], guest[-1], strings[-1], prints[-1:])
                at = [i for i in range(len(ids) - 1) if not guest[i] and part[i] == part[i + 1]]
                if at:
                    yield result(ids, strings, prints, at)
        # every part ends with a guest, so nothing is left over

    def result(ids, strings, prints, at) -> pa.RecordBatch:
        edited = [(s := strings[i])[:len(s) - len(s) // 2] + strings[i + 1][:len(s) // 2] for i in at]
        theirs = fingerprints(_texts_of(edited))
        own, following = prints[at], prints[[i + 1 for i in at]]
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in at], pa.int64()), pa.array([len(strings[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([bytes(x).hex() for x in own]), pa.array([bytes(x).hex() for x in theirs]),
            pa.array(likeness(own, theirs)), pa.array(likeness(own, following)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, RESULT)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """All pairs (query id, index id, distance) of a stated query set against all index rows whose
    fingerprints differ in at most `radius` bits. The bits are cut into radius + 1 blocks; each block in
    turn leads a permuted table, and by the pigeonhole principle a true pair agrees on a whole block.
    Equal fingerprints are joined once per distinct value and expanded to ids at the end. Null
    fingerprints match nothing."""
    blocks = radius + 1
    digits = BITS // 4
    bounds = [digits * b // blocks for b in range(blocks + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        cut = F.array(*[F.struct(F.lit(b).alias("b"), F.substring(name, bounds[b] + 1, bounds[b + 1] - bounds[b]).alias("v")) for b in range(blocks)])
        return (df.where(F.col(fp_col).isNotNull()).select(F.col(fp_col).alias(name)).distinct()
                .select(name, F.explode(cut).alias("x")).select(name, "x.b", "x.v"))

    q, i = tables(queries, "q_fp"), tables(index, "i_fp")
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(half("q_fp", at).bitwiseXOR(half("i_fp", at))) for at in range(1, digits, 8)), F.lit(0))
    pairs = q.join(i, ["b", "v"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    pairs = pairs.select("q_fp", "i_fp", "distance").distinct()
    return (pairs.join(queries.select(F.col(id_col).alias("query_id"), F.col(fp_col).alias("q_fp")), "q_fp")
            .join(index.select(F.col(id_col).alias(id_col), F.col(fp_col).alias("i_fp")), "i_fp")
            .select("query_id", id_col, "distance"))

