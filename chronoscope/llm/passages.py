"""Repeated passages: suffix automata of reference shards, matching statistics, and removal of the
maximal spans that reach the length threshold.

A window of 20 consecutive words is a repeat if its words also start earlier (smaller doc_id, or the
same document and an earlier word); every word that a repeat covers is removed.

One automaton of the whole reference would have to meet every document, and so would each of many
automata of its shards. Instead the shards are cut by content, such that a document meets only the
automata that can hold its words: each window is led by an anchor, the run of five words with the
smallest hash among its sixteen. Equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a document is dealt out as segments of 20 to 35 words, one per anchor.

1. Only the anchor, the place and a hash of each segment are shuffled. An anchor that comes once holds
   no repeat. Segments that are equal as a whole are repeats but for the first.
2. Where an anchor has different segments, the first of each kind is looked up in its document, and
   they are streamed in order of their place through the suffix automaton of those before them (the
   anchor's reference shard): where the matching statistic reaches 20, a window starts earlier; the
   segment then joins the automaton.

Words are compared by 64-bit hashes. Two cases are treated apart, with the same result. Texts of which
there are very many copies (counted exactly; at most COPY_SHARE can be so frequent) are dealt out once,
and the later copies are repeats as a whole. Anchors with very many different segments, as a sample of
the documents shows, would make large automata; their windows are dealt out singly instead, by the hash
of all their words, and then only the first of equal ones is needed, which is aggregated before the
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_partitions, stored
from .textbatch import BASE, BASE_INV, Texts, mix64, powers, rolling, text_parts

WINDOW = 20
ANCHOR = 5
SAMPLE = 64
FREQUENT = 128
MOST_FREQUENT = 100_000
#: a text is treated as very frequent from COPIES copies and a share of 1 / COPY_SHARE of the rows
COPIES = 64
COPY_SHARE = 100_000
SEGMENT = "key long, doc_id long, place long, tag long"
SPAN = "doc_id long, mark long, first long, last long, key long"
LOW = WHOLE = 0xFFFFFFFF
#: a segment has WINDOW to WINDOW + 15 words; the tag holds the excess in its low bits
SIZE_BITS = 4


class SuffixAutomaton:
    """Of a growing set of word sequences; tells how long a suffix of what was read it contains."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, string: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in string:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def repeats(self, string: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of the string that are covered by contained pieces of `least` words."""
        nxt, link, length = self.next, self.link, self.length
        at, n, spans = 0, 0, []
        for i, c in enumerate(string):
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            if c in nxt[at]:
                at, n = nxt[at][c], n + 1
            else:
                n = 0
            if n >= least:
                if spans and spans[-1][1] >= i + 1 - least:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - least, i + 1))
        return spans


def _anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the first word of every window; the place and the hash of the window's anchor."""
    words = texts.word_hashes()
    n = len(words) - WINDOW + 1
    if n <= 0:
        return words, *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    value = rolling(words, ANCHOR)
    place = np.arange(len(value))
    width = 1
    while width < WINDOW - ANCHOR + 1:  # 1, 2, 4, 8, 16: the smaller of two halves, the left one if equal
        left = value[:-width] <= value[width:]
        value, place = np.where(left, value[:-width], value[width:]), np.where(left, place[:-width], place[width:])
        width *= 2
    first = np.arange(n)
    doc = np.searchsorted(texts.word_offsets, first, side="right") - 1
    whole = np.flatnonzero(first + WINDOW <= texts.word_offsets[doc + 1])
    return words, whole, place[whole], value[whole]


def segments(docs: DataFrame, frequent: np.ndarray, single: bool = False) -> DataFrame:
    """docs(doc_id, text, mark) -> key (anchor), doc_id, place, tag (hash and size) of every segment. place:
    31 bits of the text's hash, so that texts under one id are told apart, then 32 bits of the first
    word. Windows led by a frequent anchor are left out; with `single` they are what is returned, each
    by itself and with the hash of its words as key."""
    hot = np.sort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark").to_numpy(zero_copy_only=False)
            for start, stop, texts in text_parts(batch.column("text")):
                words, first, place, value = _anchors(texts)
                if not len(first):
                    continue
                is_hot = np.zeros(len(first), bool)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
                if single:
                    begin = np.flatnonzero(is_hot)
                    keys = rolling(words, WINDOW)[first[begin]]
                    tag = np.zeros(len(begin), np.int64)
                else:
                    doc = np.searchsorted(texts.word_offsets, first, side="right") - 1
                    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
                    begin = np.flatnonzero(new)
                    last = np.concatenate([begin[1:], [len(first)]]) - 1
                    begin, last = begin[~is_hot[begin]], last[~is_hot[begin]]
                    keys, excess = value[begin], (first[last] - first[begin]).astype(np.uint64)
                    content = _range_hashes(words, first[begin], first[last] + WINDOW)
                    tag = (content >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | excess).view(np.int64)
                if not len(begin):
                    continue
                doc = np.searchsorted(texts.word_offsets, first[begin], side="right") - 1
                local, row = first[begin] - texts.word_offsets[doc], start + doc
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids.take(pa.array(row)), pa.array((marks[row] << 32) | local), pa.array(tag)], names=["key", "doc_id", "place", "tag"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, SEGMENT)


def _range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end, the same wherever they stand."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=total[1:])
    return mix64((total[end] - total[start]) * powers(BASE_INV, len(words) + 1)[start])


def _frequent_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors that lead FREQUENT or more different segments in one of SAMPLE parts of the documents;
    the MOST_FREQUENT of them at most."""
    part = rows.where(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(SAMPLE)) == 0)
    kinds = segments(part, np.zeros(0, np.uint64)).select("key", "tag").distinct()
    counts = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()
    return np.array([r["key"] for r in found], np.int64).view(np.uint64)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark (31 bits of the text's hash) and copy: whether it is a later copy of a very
    frequent text. At most COPY_SHARE texts are that frequent, so they are broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    copies = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("at")).where(F.col("n") >= COPIES), "passages-copies")
    total = rows.count()
    often = copies.where(F.col("n") * COPY_SHARE >= total).select(F.col("hash").alias("h"), F.lit(True).alias("often"), F.col("at.doc_id").alias("earliest"))
    copy = F.coalesce("often", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("earliest"))
    return rows.join(F.broadcast(often), F.col("hash") == F.col("h"), "left").select("doc_id", "text", F.shiftrightunsigned("hash", 33).alias("mark"), copy.alias("copy"))


def _groups(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple]:
    """Rows sorted by key, doc_id, place: (new group?, key, doc_id, mark, first word, value), without
    those whose key comes once inside a batch, and without rows that repeat a place."""
    key, previous = None, None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        n = len(keys)
        if not n:
            continue
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [n]])
        several = np.diff(edges) > 1
        several[0] = several[-1] = True  # these may go on in another batch
        ids, places, values = batch.column("doc_id"), batch.column("place").to_numpy(), batch.column(value)
        for g in np.flatnonzero(several).tolist():
            a, b = int(edges[g]), int(edges[g + 1])
            fresh = key is None or keys[a] != key
            key = keys[a]
            for doc_id, place, v in zip(ids[a:b].to_pylist(), places[a:b].tolist(), values[a:b].to_pylist()):
                if not fresh and (doc_id, place) == previous:
                    continue
                previous = (doc_id, place)
                yield fresh, int(key), doc_id, place >> 32, place & LOW, v
                fresh = False


def _spans(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield _span_batch(held)
            held = []
    if held:
        yield _span_batch(held)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "mark", "first", "last", "key"])


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of segments that come earlier as a whole (key null); and the first segment of each kind of
    an anchor that has several kinds (with its key)."""
    def rows():
        seen: set[int] = set()
        waiting = None
        for fresh, key, doc_id, mark, first, tag in _groups(batches, "tag"):
            last = first + WINDOW + (tag & ((1 << SIZE_BITS) - 1))
            if fresh:
                seen, waiting = {tag}, (doc_id, mark, first, last, key)
            elif tag in seen:
                yield doc_id, mark, first, last, None
            else:
                seen.add(tag)
                if waiting:
                    yield waiting
                    waiting = None
                yield doc_id, mark, first, last, key

    return _spans(rows())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each anchor in order -> spans that its automaton of the earlier ones contains."""
    def rows():
        automaton = None
        for fresh, _, doc_id, mark, first, raw in _groups(batches, "words"):
            words = np.frombuffer(raw, np.uint64).tolist()
            if fresh:
                automaton = SuffixAutomaton()
            else:
                for a, b in automaton.repeats(words, WINDOW):
                    yield doc_id, mark, first + a, first + b, None
            automaton.add(words)

    return _spans(rows())


def _with_texts(rows: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """rows(doc_id, text, mark) joined with the lists of their spans; both uses shuffle the rows alike."""
    lists = by_doc.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last", "key")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "spans")
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), how).select("doc_id", "text", "mark", "spans")


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with wanted segments -> the segments' word hashes."""
    for batch in batches:
        ids, marks, spans = batch.column("doc_id"), batch.column("mark").to_pylist(), batch.column("spans")
        for start, stop, texts in text_parts(batch.column("text")):
            words = texts.word_hashes()
            out = []
            for d in range(len(texts)):
                own = words[texts.word_offsets[d]:texts.word_offsets[d + 1]]
                doc_id, mark = ids[start + d].as_py(), marks[start + d]
                out += [(s["key"], doc_id, mark << 32 | s["first"], own[s["first"]:s["last"]].tobytes()) for s in spans[start + d].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "doc_id", "place", "words"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """marked() rows -> doc_id, mark, first, last, key: runs of words to remove. They may overlap; one
    that ends at WHOLE stands for the whole text if that has a window at all."""
    parts = shuffle_partitions(rows.sparkSession)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "place")

    known = rows.where(F.col("text").isNotNull() & ~F.col("copy"))
    frequent = _frequent_anchors(known)
    found = stored(dealt(segments(known, frequent)).mapInArrow(_whole_segments, SPAN), "passages-found")
    wanted = _with_texts(rows, found.where(F.col("key").isNotNull()), "inner").mapInArrow(_look_up, "key long, doc_id long, place long, words binary")
    copies = rows.where("copy").select("doc_id", "mark", F.lit(0).cast("long").alias("first"), F.lit(WHOLE).cast("long").alias("last"), F.lit(None).cast("long").alias("key"))
    spans = found.where(F.col("key").isNull()).unionByName(dealt(wanted).mapInArrow(_stream, SPAN)).unionByName(copies)
    if not len(frequent):
        return spans
    single = segments(known, frequent, single=True).select("key", F.struct("doc_id", "place").alias("at"))
    earliest = single.groupBy("key").agg(F.min("at").alias("earliest"))
    later = single.join(earliest, "key").where(~F.col("at").eqNullSafe(F.col("earliest")))
    first = F.col("at.place").bitwiseAND(F.lit(LOW).cast("bigint"))
    later = later.select(F.col("at.doc_id").alias("doc_id"), F.shiftrightunsigned("at.place", 32).alias("mark"), first.alias("first"), (first + WINDOW).alias("last"), F.lit(None).cast("long").alias("key"))
    return spans.unionByName(later)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that stays, words joined by a space) of
    every row. Null and empty texts have no words. Rows that repeat an id and text are one document and
    get the same result; different texts under one id are ordered by their hash. Other columns are
    ignored; an empty table gives an empty result."""
    rows = marked(docs)
    joined = _with_texts(rows, repeated_spans(rows), "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, firsts, lasts = (batch.column(c) for c in ("doc_id", "text", "first", "last"))
            for at in range(0, batch.num_rows, 256):
                total, gone, digest, kept = [], [], [], []
                stop = min(at + 256, batch.num_rows)
                for i in range(at, stop):
                    words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    if firsts[i].is_valid:
                        change = np.zeros(n + 1, np.int64)
                        if n >= WINDOW:
                            np.add.at(change, np.asarray(firsts[i].values), 1)
                            np.add.at(change, np.minimum(np.asarray(lasts[i].values), n), -1)
                        words = list(compress(words, (np.cumsum(change[:n]) == 0).tolist()))
                    text = b" ".join(words)
                    total.append(n)
                    gone.append(n - len(words))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
