"""A stored random number that splits any group of rows evenly, copies included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgwarden.sources.tables import settle

SPREAD = "spread"


def with_spread(df: DataFrame) -> DataFrame:
    """Add the number. Write the result before using it: see ``spread_stored``."""
    return df.withColumn(SPREAD, F.floor(F.rand() * F.lit(2**31 - 1)).cast("int"))


def spread_stored(df: DataFrame) -> DataFrame:
    """The frame with a number that is fixed for each row.

    A table that was published with the number has it already; any other frame is written to
    scratch space once. A task that runs again after a lost executor then finds the same numbers.
    """
    return df if SPREAD in df.columns else settle(with_spread(df))
