"""Seeded, partition-independent randomness as Spark column expressions.

A draw is a function of (seed, key...) only:
    u(seed, k...) = int(first 8 hex digits of md5("seed|k1|k2...")) / 2**32      in [0, 1)
    normal        = Box-Muller on the first and second 8 hex digits of the same md5
Keys must be integer or string columns (their text form is identical in every engine);
a str argument names a column, a literal key is passed as F.lit(...).
The same formulas are written in SQL by `chronoscope.plans.oracle`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0
EPS_LN = 2.0 ** -33


def _as_col(k) -> Column:
    """Column as is; a str names a column; other values are literals (use F.lit for literal text)."""
    if isinstance(k, Column):
        return k
    if isinstance(k, str):
        return F.col(k)
    return F.lit(str(k))


def _key(seed, keys) -> Column:
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.concat_ws("|", *parts)


def md5_key(seed, *keys) -> Column:
    return F.md5(_key(seed, keys))


def hex_to_unit(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("double") / F.lit(TWO32)


def uniform(seed, *keys) -> Column:
    """U[0,1) from the first 8 hex digits of md5(seed|keys)."""
    return hex_to_unit(F.substring(md5_key(seed, *keys), 1, 8))


def uniform_int(seed, *keys) -> Column:
    """The 32-bit integer behind `uniform` (used as a sort key for shuffles)."""
    return F.conv(F.substring(md5_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def normal(seed, *keys) -> Column:
    """N(0,1) by Box-Muller from digits 1-8 and 9-16 of one md5."""
    h = md5_key(seed, *keys)
    u1 = hex_to_unit(F.substring(h, 1, 8))
    u2 = hex_to_unit(F.substring(h, 9, 8))
    return F.sqrt(F.lit(-2.0) * F.log(u1 + F.lit(EPS_LN))) * F.cos(F.lit(2.0 * math.pi) * u2)


def sort_key60(seed, *keys) -> Column:
    """60-bit integer from md5 (15 hex digits) for shuffles and global ranks."""
    return F.conv(F.substring(md5_key(seed, *keys), 1, 15), 16, 10).cast("bigint")


def uniform_chunk(md5_hex: Column, chunk: Column) -> Column:
    """The chunk-th (0..3) 32-bit draw of one md5: four uniforms per hash."""
    return F.conv(md5_hex.substr(chunk * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(TWO32)
