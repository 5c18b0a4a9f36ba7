"""Optional predicates and their composition."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates that are given; true if none is."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def wanted_status(status: str | None) -> str | None:
    """The status to filter by in upper case; none for an absent or empty one and for ``ALL``."""
    wanted = (status or "").upper()
    return None if wanted in ("", "ALL") else wanted


def status_is(column: str, status: str | None) -> Column | None:
    """Equality with the wanted status, or no predicate."""
    wanted = wanted_status(status)
    return None if wanted is None else F.col(column) == F.lit(wanted)


def with_level(df: DataFrame, level: str | None) -> DataFrame:
    """Rows of one level; every row without a level. Raises if there is no level column."""
    return df if level is None else df.filter(F.col("level") == F.lit(level))
