"""Total orders with nulls last, and positions in such an order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.operators.spread import SPREAD, spread_stored


@dataclass(frozen=True)
class SortKey:
    """One column of an order; nulls come last in both directions."""

    column: str
    descending: bool = False

    def expression(self) -> Column:
        column = F.col(f"`{self.column}`")
        return column.desc_nulls_last() if self.descending else column.asc_nulls_last()


def comparable(data_type: T.DataType) -> bool:
    """Whether values of the type can be written as text and read back unchanged."""
    return isinstance(data_type, T.AtomicType) and not isinstance(data_type, T.BinaryType)


def orderable(data_type: T.DataType) -> bool:
    """Whether values of the type can be compared: all but maps and what holds or hides them."""
    if isinstance(data_type, T.ArrayType):
        return orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(orderable(f.dataType) for f in data_type.fields)
    return isinstance(data_type, (T.AtomicType, T.NullType)) and not isinstance(
        data_type, T.VariantType
    )


def total_order(df: DataFrame, keys: Sequence[SortKey]) -> list[SortKey]:
    """The keys followed by all other columns, so that only equal rows are left unordered.

    Maps have no order and are left out.
    """
    named = {key.column for key in keys}
    if len(named) < len(keys):
        raise ValueError("an order must not name a column twice")
    rest = [
        SortKey(f.name)
        for f in df.schema.fields
        if f.name not in named and orderable(f.dataType)
    ]
    return [*keys, *rest]


def ordered(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """The frame in the given order."""
    return df.orderBy(*[key.expression() for key in keys])


def ordered_whole(df: DataFrame, keys: Sequence[SortKey], unique: bool = False) -> DataFrame:
    """The whole frame in order, for an export.

    Where the keys are ``unique`` no rows are equal in them, and the frame is sorted as it is.
    Otherwise
    the rows are cut into ranges of the order. The spread number, last in the order, keeps a large
    group of copies from falling into a single range. A range sort reads its input twice, to find
    the ranges and to sort, so reading stored rows also saves computing the result twice.
    """
    if unique:
        return ordered(df.drop(SPREAD), keys)
    stored = spread_stored(df)
    order = [*total_order(stored.drop(SPREAD), keys), SortKey(SPREAD)]
    return ordered(stored, order).drop(SPREAD)


@dataclass(frozen=True)
class Position:
    """A place in an order, given by one row's values of the sort columns (as text)."""

    keys: tuple[SortKey, ...]
    types: tuple[T.DataType, ...]
    values: tuple[str | None, ...]

    @cached_property
    def _comparisons(self) -> list[tuple[Column, Column, Column]]:
        """For each sort column: row sorts before this place, is equal, sorts after it."""
        found = []
        for key, data_type, text in zip(self.keys, self.types, self.values, strict=True):
            column = F.col(f"`{key.column}`")
            if text is None:
                found.append((column.isNotNull(), column.isNull(), F.lit(False)))
                continue
            value = F.lit(text).cast(data_type.simpleString())
            lower, higher = column < value, column > value
            first, last = (higher, lower) if key.descending else (lower, higher)
            found.append((first, column.eqNullSafe(value), last | column.isNull()))
        return found

    def rows_before(self) -> Column:
        """True for rows that sort strictly before this place (else false or null)."""
        *leading, (before, _, _) = self._comparisons
        for earlier, equal, _ in reversed(leading):
            before = earlier | (equal & before)
        return before

    def rows_equal(self) -> Column:
        """True for rows with exactly the values of this place."""
        return reduce(and_, [equal for _, equal, _ in self._comparisons])

    def rows_after(self) -> Column:
        """True for rows that sort strictly after this place (else false or null)."""
        *leading, (_, _, after) = self._comparisons
        for _, equal, later in reversed(leading):
            after = later | (equal & after)
        return after

    def literals(self) -> dict[str, Column]:
        """The values of this place by column."""
        return {
            key.column: F.lit(text).cast(data_type.simpleString()).alias(key.column)
            for key, data_type, text in zip(self.keys, self.types, self.values, strict=True)
        }


def copies(df: DataFrame, places: Sequence[Position], n: int) -> DataFrame:
    """``n`` equal rows with the columns of ``df``, all of whose values the places give."""
    values = {name: value for place in places for name, value in place.literals().items()}
    rows = df.sparkSession.range(0, n, numPartitions=1 + n // 100_000)
    return rows.select(*[values[name] for name in df.columns])
