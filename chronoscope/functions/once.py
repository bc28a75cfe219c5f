"""A value that a lambda reads many times and that is computed once for the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value). A projection is merged into the one that reads it, and an expression that stands inside a
    lambda is evaluated for every element; as the lambda's own variable it is evaluated before, for the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
