"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Every entry c becomes the integer x = floor(256 c) (SCALE). Over the n distinct x vectors, with sums S, the
matrix M = n * sum(x x') - S S' is n**2 times their covariance, and it is an integer matrix. All that is
asked of its spectrum is found exactly or to a stated precision:

1. M is summed exactly: each task multiplies blocks in floating point where that is exact, else in Python
   integers, and hands over limbs of LIMB bits, which Spark adds as decimals.
2. For each of enough primes, one row of a Spark job, M is reduced to Hessenberg form modulo the prime and
   its characteristic polynomial read off; Chinese remaindering gives the integer polynomial. M has no
   negative eigenvalue, so its coefficients are bounded by those of equal eigenvalues of the same trace.
3. All roots are real, so by Descartes' rule the sign changes of the polynomial shifted by a count the roots
   beyond a exactly. Bisection with integer arithmetic isolates the k-th largest root to BITS bits.
4. Inverse iteration in decimals of DIGITS digits finds the null space of M - root; vectors of equal roots
   are made orthogonal in the same precision, then rounded to double.

What reaches the driver depends on the dimension only (at most MOST_DIMENSIONS squared integers).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import ceil, comb, log2, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

SCALE = 256
COMPONENTS = 4
BITS = 160
DIGITS = 120
LIMB, LIMBS = 60, 4
MOST_DIMENSIONS = 1024
EXACT = 1 << 53
PRIMES_BELOW = 1 << 31
PRIMES_A_TASK = 16
LONG = (1 << 63) - 1


# --- integer vectors -------------------------------------------------------------------------------------------

def _encoded(x: np.ndarray) -> pa.Array:
    """Rows of integers as binary: little-endian in the narrowest of 2, 4 and 8 bytes, after a byte with that
    width; zeros at the end are left out. Equal vectors have equal bytes, whatever their padding."""
    rows, dims = x.shape
    most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if dims else np.zeros(rows, np.int64)
    width = np.select([most < 1 << 15, most < 1 << 31], [2, 4], 8)
    used = np.where(x.any(axis=1), dims - (x[:, ::-1] != 0).argmax(axis=1), 0) if dims else np.zeros(rows, np.int64)
    parts, order = [], []
    for w, n in sorted(set(zip(width.tolist(), used.tolist()))):  # most rows are of one kind
        at = np.flatnonzero((width == w) & (used == n))
        raw = np.empty((len(at), 1 + w * n), np.uint8)
        raw[:, 0] = w
        raw[:, 1:] = np.ascontiguousarray(x[at, :n].astype(f"<i{w}")).view(np.uint8).reshape(len(at), w * n)
        offsets = np.arange(len(at) + 1, dtype=np.int32) * raw.shape[1]
        parts.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        order.append(at)
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


def _decoded(keys: list[bytes], dims: int) -> np.ndarray:
    """The rows of `_encoded` again, padded to `dims`."""
    out = np.zeros((len(keys), dims), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(keys):
        kinds.setdefault((key[0], len(key)), []).append(i)
    for (width, length), at in kinds.items():
        raw = np.frombuffer(b"".join([keys[i] for i in at]), np.uint8).reshape(len(at), length)
        out[at, :(length - 1) // width] = np.ascontiguousarray(raw[:, 1:]).view(f"<i{width}")
    return out


def _scaled(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as long; what is beyond a long becomes its end."""
    with np.errstate(over="ignore"):
        scaled = np.floor(c * SCALE)
    x = np.clip(scaled, -2.0 ** 63, 2.0 ** 62).astype(np.int64)
    x[scaled >= 2.0 ** 62] = [min(int(v), LONG) if np.isfinite(v) else LONG for v in scaled[scaled >= 2.0 ** 62]]
    return x


def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x (encoded integer vector) and length of the rows whose vector is whole and finite. Entries
    beyond the range of a long are set to its ends."""
    named = rows.select("vec_id", F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pc.is_valid(batch.column("v")))
            lengths = np.asarray(pc.list_value_length(whole.column("v")))
            flat = whole.column("v").flatten()
            finite = np.isfinite(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            good = bad[ends] == bad[ends - lengths]
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
            for n in sorted(set(lengths[good].tolist())):
                at = np.flatnonzero(good & (lengths == n))
                x = _scaled(values[(ends[at] - n)[:, None] + np.arange(n)])
                yield pa.RecordBatch.from_arrays([whole.column("vec_id").take(pa.array(at)), _encoded(x), pa.array(np.full(len(at), n, np.int32))], names=["vec_id", "x", "length"])

    return named.mapInArrow(run, f"vec_id {named.schema['vec_id'].dataType.simpleString()}, x binary, length int")


# --- exact scatter ---------------------------------------------------------------------------------------------

def _exact_products(block: np.ndarray) -> np.ndarray:
    """block' block as Python integers where needed, in float64 where every partial sum is below 2**53."""
    most = max(int(block.max()), -int(block.min()), 1)
    if most * most >= EXACT:
        wide = block.astype(object)
        return wide.T @ wide
    step = max(1, EXACT // (most * most) - 1)
    total = np.zeros((block.shape[1],) * 2, object)
    for start in range(0, len(block), step):
        part = block[start:start + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(value: int) -> list[int]:
    """value in base 2**LIMB, the last limb with the sign."""
    mask = (1 << LIMB) - 1
    return [value >> (LIMB * k) & mask for k in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M of the distinct vectors fit(x), exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(dims + 1, object), np.zeros((dims, dims), object)
        for batch in batches:
            keys = batch.column("x").to_pylist()
            for start in range(0, len(keys), 4096):
                block = _decoded(keys[start:start + 4096], dims)
                wide = max(int(block.max()), -int(block.min())) >= 1 << 50
                sums[:dims] += block.astype(object).sum(axis=0) if wide else block.sum(axis=0).astype(object)
                sums[dims] += len(block)
                products += _exact_products(block)
        i, j = np.triu_indices(dims)
        cells = [*zip([-1] * (dims + 1), range(dims + 1), sums), *zip(i.tolist(), j.tolist(), products[i, j])]
        cells = [c for c in cells if c[2]]
        limbs = [_limbs(int(c[2])) for c in cells]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), *[pa.array([x[k] for x in limbs], pa.int64()) for k in range(LIMBS)]], names=["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    parts = fit.mapInArrow(run, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    whole = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)])
    value = {(r.i, r.j): sum(int(r[f"l{k}"]) << (LIMB * k) for k in range(LIMBS)) for r in whole.collect()}
    n, s = value.get((-1, dims), 0), [value.get((-1, i), 0) for i in range(dims)]
    return n, s, [[n * value.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(dims)] for i in range(dims)]


# --- characteristic polynomial ---------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide below 3.4e14."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(any(x in (1, n - 1) if k == 0 else x == n - 1 for k, x in enumerate(pow(a, odd << t, n) for t in range(twos))) for a in (2, 3, 5, 7, 11, 13, 17))


def primes_for(bits: int) -> list[int]:
    """The largest primes below PRIMES_BELOW whose product has more than `bits` bits."""
    found, have, at = [], 0.0, PRIMES_BELOW - 1
    while have <= bits + 1:
        if is_prime(at):
            found.append(at)
            have += log2(at)
        at -= 2
    return found


def coefficient_bits(trace: int, dims: int) -> int:
    """Bits of the largest coefficient that non-negative eigenvalues of this trace can give."""
    return max(ceil(log2(comb(dims, k)) + k * max(0.0, log2(trace) - log2(dims))) + 2 for k in range(dims + 1)) if trace else 1


def hessenberg_mod(m: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the subdiagonal."""
    a = m % p
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        q = k + 1 + int(below[0])
        if q != k + 1:
            a[[q, k + 1]] = a[[k + 1, q]]
            a[:, [q, k + 1]] = a[:, [k + 1, q]]
        u = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * u % p).sum(axis=1)) % p
    return a


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """det(z - m) modulo p, coefficients from z**0 up (the last is 1)."""
    h = hessenberg_mod(m, p)
    d = len(h)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    below = np.zeros(d, np.int64)  # below[i]: product of the subdiagonal from i + 1 to k
    for k in range(d):
        if k:
            below[:k] = below[:k] * h[k, k - 1] % p
        below[k] = 1
        weights = h[:k + 1, k] * below[:k + 1] % p
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[:k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(z - M), from z**0 up, for M symmetric without negative eigenvalues."""
    dims = len(m)
    primes = primes_for(coefficient_bits(sum(m[i][i] for i in range(dims)), dims) + 1)
    wide = np.array(m, object).reshape(dims, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [primes[i] for i in batch.column("id").to_pylist()]
            found = [polynomial_mod((wide % p).astype(np.int64), p).tolist() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = ceil(len(primes) / PRIMES_A_TASK)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "p long, c array<long>").collect()
    whole = prod(r.p for r in rows)
    lift = [(whole // r.p) * pow(whole // r.p, -1, r.p) for r in rows]
    found = [sum(r.c[k] * x for r, x in zip(rows, lift)) % whole for k in range(dims + 1)]
    return [c - whole if 2 * c > whole else c for c in found]


# --- roots and components --------------------------------------------------------------------------------------

def roots_beyond(poly: list[int], a: int, shift: int) -> int:
    """How many roots, all of them real, are larger than a / 2**shift: the sign changes of the polynomial
    moved there, in integers."""
    d = len(poly) - 1
    q = [c << (shift * (d - k)) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            q[k] += a * q[k + 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_root(poly: list[int], k: int, top: int) -> tuple[int, int]:
    """(a, shift): the k-th largest root (counted as often as it is one) lies in (a, a + 1] / 2**shift, with
    a of BITS bits; (0, 0) if it is zero. top: a number that no root exceeds."""
    if roots_beyond(poly, 0, 0) < k:
        return 0, 0
    low, high = 0, top  # the root lies in (low, high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if roots_beyond(poly, mid, 0) >= k else (low, mid)
    shift = 0
    while low.bit_length() < BITS:
        step = min(32, BITS - low.bit_length()) or 1
        shift += step
        low, high = low << step, high << step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if roots_beyond(poly, mid, shift) >= k else (low, mid)
    return low, shift


def _solver(m: list[list[int]], root: Decimal):
    """Solves (M - root) y = b by elimination with row pivots; a pivot that vanishes is taken as tiny."""
    d = len(m)
    tiny = Decimal(10) ** -(DIGITS - 20) * max(Decimal(1), abs(root))
    a = [[Decimal(x) - (root if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)]
    steps = []
    for k in range(d):
        q = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[q] = a[q], a[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        factors = []
        for i in range(k + 1, d):
            f = a[i][k] / a[k][k]
            factors.append(f)
            if f:
                row, top = a[i], a[k]
                for j in range(k + 1, d):
                    row[j] -= f * top[j]
        steps.append((q, factors))

    def solve(b: list[Decimal]) -> list[Decimal]:
        y = list(b)
        for k, (q, factors) in enumerate(steps):
            y[k], y[q] = y[q], y[k]
            for i, f in enumerate(factors, k + 1):
                y[i] -= f * y[k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - sum((a[k][j] * y[j] for j in range(k + 1, d)), Decimal(0))) / a[k][k]
        return y

    return solve


def _unit(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    for o in others:
        along = sum((x * y for x, y in zip(v, o)), Decimal(0))
        v = [x - along * y for x, y in zip(v, o)]
    size = sum((x * x for x in v), Decimal(0)).sqrt()
    return [x / size for x in v] if size else v


def null_vectors(m: list[list[int]], root: Decimal, count: int) -> list[list[float]]:
    """`count` orthogonal unit vectors v with M v = root v, each with its largest entry positive."""
    with localcontext() as ctx:
        ctx.prec = DIGITS
        solve, found = _solver(m, root), []
        for c in range(count):
            # fixed start vectors without regularity, another one for each vector
            v = _unit([Decimal(1 + (i * (c + 3) * 2654435761 + c * 40503) % 104729) for i in range(len(m))], found)
            for _ in range(3):
                v = _unit(solve(v), found)
            found.append(_unit(v, found))
        out = []
        for v in found:
            sign = 1 if max(v, key=abs) > 0 else -1
            out.append([float(sign * x) for x in v])
        return out


def components(spark: SparkSession, m: list[list[int]], count: int = COMPONENTS) -> list[tuple[Decimal, list[float]]]:
    """The `count` largest eigenvalues of M above zero with their unit vectors, one Spark task for each."""
    dims = len(m)
    trace = sum(m[i][i] for i in range(dims))
    if not trace:
        return []
    poly = characteristic_polynomial(spark, m)
    wanted = min(count, dims)

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column("id").to_pylist()
            roots = [largest_root(poly, k, trace) for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([str(a) for a, _ in roots]), pa.array([s for _, s in roots], pa.int32())], names=["k", "a", "shift"])

    roots = spark.range(1, wanted + 1, 1, wanted).mapInArrow(isolate, "k long, a string, shift int").collect()
    with localcontext() as ctx:
        ctx.prec = DIGITS
        # the middle of the interval; equal intervals are one root
        groups: dict[Decimal, int] = {}
        for r in sorted(roots, key=lambda r: r.k):
            if int(r.a) or r.shift:
                at = (2 * Decimal(r.a) + 1) / Decimal(2 ** (r.shift + 1))
                groups[at] = groups.get(at, 0) + 1
    distinct = list(groups.items())
    if not distinct:
        return []

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([null_vectors(m, *distinct[k]) for k in ks], pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    solved = spark.range(0, len(distinct), 1, len(distinct)).mapInArrow(solve, "k long, v array<array<double>>").collect()
    return [(distinct[r.k][0], list(v)) for r in sorted(solved, key=lambda r: r.k) for v in r.v]


# --- whitening -------------------------------------------------------------------------------------------------

def _projected(rows: DataFrame, dims: int, n: int, s: list[int], found: list[tuple[Decimal, list[float]]], keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, deviation and w (the whitened values of all components). The vectors are centred
    as integers n * x - S."""
    axes = np.array([v for _, v in found]).reshape(len(found), dims)
    scales = np.array([1.0 / float(root.sqrt()) for root, _ in found])
    most_s, sums = max([abs(x) for x in s], default=0), np.array(s, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("x").to_pylist()
            x = _decoded(keys, dims)
            most = n * max(int(x.max()), -int(x.min())) + most_s if x.size else 0
            centred = n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums
            exact = (centred * centred).sum(axis=1) if most * most * dims < 1 << 62 else (centred.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([int(d) if d <= LONG else None for d in exact], pa.int64())
            w = (centred.astype(np.float64)[:, None, :] * axes[None, :, :]).sum(axis=2) * scales
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], deviation, pa.array(list(w), pa.list_(pa.float64()))], names=[*keep, "deviation", "w"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "x").mapInArrow(run, f"{fields}{', ' if keep else ''}deviation long, w array<double>")


def whitened(rows: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row for each row
    with a usable vector and each of the `count` largest components.

    Rows whose vector is null or holds a null or a non-finite entry are dropped; other columns are ignored.
    Repeated rows and null ids stay; a vector counts once in the fit however often it stands. Shorter
    vectors are read as if zeros followed (an empty one: all zeros). Components with eigenvalue zero cannot
    be scaled and have no rows, so a table with fewer than two different vectors gives none, as does an
    empty table. deviation is null where it is beyond a long. More than MOST_DIMENSIONS entries are an error.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, vector)
    kinds = vectors.groupBy("x").agg(F.max("length").alias("length"))
    fit = stored(kinds, "whitening-fit")
    dims = fit.agg(F.max("length")).first()[0] or 0
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; at most {MOST_DIMENSIONS} are taken")
    n, s, m = scatter(fit.select("x"), dims) if dims else (0, [], [])
    found = components(spark, m, count)
    trace = sum(m[i][i] for i in range(dims))
    k = len(found)
    error = 0.0
    if k:
        over_fit = _projected(fit, dims, n, s, found, ()).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = over_fit.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, r))
    named = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(root / trace)).alias("explained")) for i, (root, _) in enumerate(found)]) if k else F.array().cast("array<struct<component:int,explained:double>>")
    out = _projected(vectors, dims, n, s, found, ("vec_id",)).select("vec_id", "deviation", F.explode(F.arrays_zip(named.alias("name"), F.col("w"))).alias("c"))
    return out.select("vec_id", F.col("c.name.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.name.explained").alias("explained"), F.lit(error).alias("identity_error"))
