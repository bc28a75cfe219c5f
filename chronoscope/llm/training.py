"""Bounded, reproducible training samples for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbatch import hashed_features, text_parts

HASH_CELLS = 1 << 20


def held_out(key: str = "doc_id"):
    """crc32 of the id as text leaves 2 on division by 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def named_once(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys that stand in one row only: another names no one text, and would bring all of its rows to the
    sample for each of them."""
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select(key)


def bounded_sample(keys: DataFrame, label: str, per_class: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """At most `per_class` rows (key, label) of each label, chosen by a hash of the key; and the counts of
    all rows by label. A class is first thinned by the hash to about three times the bound, so that no
    task ever ranks more than that, however large the class is."""
    counts = {r[label]: r["n"] for r in keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return keys.select(key, label).limit(0), counts
    cell = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(HASH_CELLS))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (cell < F.lit(min(HASH_CELLS, -(-3 * per_class * HASH_CELLS // n)))))
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit("order"), F.col(key)), key)
    return keys.where(keep).select(key, label).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= per_class).drop("_nth"), counts


def sample_features(docs: DataFrame, sample: DataFrame, label: str, sizes: tuple[int, ...], bits: int, words: bool = True, characters: bool = False, key: str = "doc_id") -> tuple[list[np.ndarray], list[np.ndarray], list]:
    """Bucket ids, relative frequencies and label of each sampled document, in an order that depends
    on the ids alone. The sample has a proven bound, so it is broadcast to the texts, and its sparse
    vectors (at most 2**bits entries each) come to the driver."""
    label_type = sample.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_parts(batch.column("text")):
                kinds = list(hashed_features(texts, sizes, bits, words, characters))
                ids, freq = [], []
                for d in range(len(texts)):
                    bucket, n = np.unique(np.concatenate([b[o[d]:o[d + 1]] for b, o in kinds]), return_counts=True)
                    ids.append(bucket.astype(np.int32))
                    freq.append((n / max(1, n.sum())).astype(np.float32))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array(ids, pa.list_(pa.int32())), pa.array(freq, pa.list_(pa.float32()))], names=["k", "y", "ids", "freq"])

    chosen = (docs.select(F.col(key).alias("k"), "text").join(F.broadcast(sample.select(F.col(key).alias("k"), F.col(label).alias("y"))), "k")
              .select("k", "y", "text").mapInArrow(run, f"k long, y {label_type}, ids array<int>, freq array<float>").toArrow())
    if not chosen.num_rows:
        return [], [], []
    chosen = chosen.combine_chunks()
    ids, freq, labels, keys = chosen["ids"], chosen["freq"], chosen["y"].to_pylist(), chosen["k"].to_numpy()
    vectors = [(np.asarray(ids[i].values), np.asarray(freq[i].values)) for i in range(chosen.num_rows)]
    order = sorted(range(chosen.num_rows), key=lambda i: (int(keys[i]) * 0x9E3779B97F4A7C15 % (1 << 64), str(labels[i]), len(vectors[i][0])))
    return [vectors[i][0] for i in order], [vectors[i][1] for i in order], [labels[i] for i in order]
