"""Words and n-grams of Arrow text batches as numpy arrays (no Python object per word).

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, so the split is the regular
expression [^\\x20\\x09-\\x0D]+ on whole texts. Word hashes are polynomials over the UTF-8 bytes modulo
2**64 (prefix sums, one pass over the buffer), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown by doubling."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[base] = have
    return have[:n]


class Texts:
    """A run of whole texts: bytes, document offsets, and the word table of all of them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        word = ~IS_SPACE[buf]
        first = np.ones(n + 1, bool)
        first[1:] = ~np.concatenate([word])
        first[offsets] = True
        self.starts = np.flatnonzero(word & first[:-1])
        last = np.ones(n, bool)
        if n:
            last[:-1] = ~word[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            last[inner - 1] = True
        self.ends = np.flatnonzero(word & last) + 1
        #: words of document d: self.word_offsets[d] .. self.word_offsets[d + 1]
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def prefix(self) -> np.ndarray:
        """prefix[i]: sum over j < i of (byte j + 1) * BASE**j."""
        if self._prefix is None:
            n = len(self.buf)
            out = np.zeros(n + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=out[1:])
            self._prefix = out
        return self._prefix

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end, the same wherever the bytes stand."""
        h = self.prefix()
        raw = (h[end] - h[start]) * powers(BASE_INV, len(self.buf) + 1)[start]
        return mix64(raw)

    def word_hashes(self) -> np.ndarray:
        return self.range_hashes(self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words of a document, and their offsets by document. A
        document of 1 to k - 1 words has one shingle of all its words; one without words has none."""
        words, offs, n = self.word_hashes(), self.word_offsets, self.n_words
        if len(words) >= k:
            combined = rolling(words, k)
            at = np.arange(len(combined))
            doc = np.searchsorted(offs, at, side="right") - 1
            whole = at + k <= offs[doc + 1]
            combined, doc = combined[whole], doc[whole]
        else:
            combined, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            alone = np.array([sequence_hash(words[offs[d]:offs[d + 1]]) for d in short], np.uint64)
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            combined, doc = np.concatenate([combined, alone])[order], doc[order]
        return combined, np.searchsorted(doc, np.arange(len(self) + 1))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i + k - 1 for every i (also across documents)."""
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j:len(words) - k + 1 + j]
    return mix64(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    out = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            out = out * np.uint64(BASE) + w
    return mix64(np.array([out], np.uint64))[0]


def text_parts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cuts a text column into runs of whole texts of about chunk_bytes: (first row, last row + 1,
    texts). Null counts as empty; a longer text is a run by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, Texts(raw[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def sums_by_offsets(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] (0 for empty runs); values may be a matrix."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of every code point as one number, whether it is a separator, and the offsets of the
    documents in code points."""
    starts = np.flatnonzero((texts.buf & 0xC0) != 0x80)
    length = np.diff(np.append(starts, len(texts.buf)))
    value = texts.buf[starts].astype(np.uint64)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        value[longer] = (value[longer] << np.uint64(8)) | texts.buf[starts[longer] + k]
    return value, IS_SPACE[texts.buf[starts]], np.searchsorted(starts, texts.offsets)


def hashed_features(texts: Texts, sizes: tuple[int, ...], bits: int, words: bool = True, characters: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text, kind by kind: (bucket of every occurrence, offsets by document).
    Kinds: whole words, and n-grams of each size, of bytes or of characters (code points), that lie in one
    word together with at most one separator (read as a space) at either end."""
    shift = np.uint64(64 - bits)
    if words:
        yield ((texts.word_hashes() ^ MIX_1) * np.uint64(BASE) >> shift).astype(np.int32), texts.word_offsets
    if characters:
        units, space, offsets = code_points(texts)
    else:
        units, space, offsets = texts.buf, IS_SPACE[texts.buf], texts.offsets
    flat = np.where(space, units.dtype.type(0x20), units)
    ends = offsets[1:]
    for size in sizes:
        n = len(flat) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
            continue
        code = np.zeros(n, np.uint64)
        bad = np.zeros(n, bool)
        for j in range(size):
            part = flat[j:j + n].astype(np.uint64)
            code = mix64(code ^ part) if characters else code | part << np.uint64(8 * j)
            if 0 < j < size - 1:
                bad |= space[j:j + n]
        for j in range(1, size):
            cross = ends - j
            bad[cross[(cross >= 0) & (cross < n)]] = True
        at = np.flatnonzero(~bad)
        yield ((code[at] * np.uint64(BASE) + np.uint64(size)) * MIX_2 >> shift).astype(np.int32), np.searchsorted(at, offsets)


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run values[offsets[i]:offsets[i + 1]], each run summed by itself (so a document's
    sum does not depend on its neighbours); 0 for empty runs."""
    out = np.zeros(len(offsets) - 1, np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out
