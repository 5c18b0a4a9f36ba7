"""Vectors that take part in an operator, and matrices of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vec: Column) -> Column:
    """Whether an array of doubles is present and holds finite numbers only."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite, F.lit(False))


def of_one_length(df: DataFrame, vec: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length (of several the smallest), and that length.

    Vectors without entries take no part; the length is 0 where nothing is left.
    """
    found = df.filter(F.size(vec) > 0)
    lengths = found.groupBy(F.size(vec).alias("length")).count()
    most = lengths.orderBy(F.desc("count"), "length").first()
    length = most["length"] if most else 0
    return found.filter(F.size(vec) == length), length


def scaled(vec: str, factor: int, shift: int = 0, limit: int = 1 << 40) -> Column:
    """``floor(factor * c) + shift`` of each entry; what lies outside the limit is taken as the
    limit, so that sums of products stay exact."""
    held = lambda c: F.greatest(F.least(c * factor, F.lit(float(limit))), F.lit(-float(limit)))
    return F.transform(vec, lambda c: (F.floor(held(c)) + shift).cast("long"))


def matrix(column: Sequence, dtype: type = np.float64) -> np.ndarray:
    """The arrays of a column as rows of a matrix."""
    return np.stack([np.asarray(v, dtype) for v in column]) if len(column) else np.empty((0, 0), dtype)
