"""Places of stored rows in several orders, so that a page at any depth is read directly.

The table is written in its base order, with a row number that ascends in it. For each column that rows may
be sorted by, the rows of each value are counted by block of row numbers. These cells are written in the order of
the column, in both directions (cells of one value by block, so its rows are in the base order), by one range
sort for all orders. A cell has the places of its rows, without a row for each. A small table holds
the number of rows before each range of cells.

A page then takes a look at the ranges, reads the cells that its places lie in, finds its row numbers in the blocks
that they name, and reads these rows; the number of jobs and the rows they read do not depend on how
deep the page lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.operators.ordering import SortKey, ordered
from pkgwarden.sources import tables

ROW = "row_number"
#: The number of the base order; column ``i`` has the numbers ``2 i`` and ``2 i + 1`` (descending).
BASE = -1
#: Bits of a number that count within a task's output (``monotonically_increasing_id``), and bits of a place
#: that do: a task writes few cells of many rows.
PART_BITS = 33
PLACE_BITS = 44
#: Bits of a row number that count within a block. A page reads its first and last block, not more.
BLOCK_BITS = 20
#: A page of more rows is joined with its row numbers, one of fewer names them in the filter.
NAMED_ROWS = 2_000
#: Stretches of row numbers that a filter names.
STRETCHES = 16

#: Rows of one value in one block, and the places of the first and the last of them.
CELLS = T.StructType(
    [
        T.StructField("ordering", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("last", T.LongType()),
    ]
)
RANGES = T.StructType(
    [
        T.StructField("ordering", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def numbering(column: str, columns: Sequence[str], descending: bool = False) -> int:
    """The number of the order by one of the indexed columns."""
    return 2 * list(columns).index(column) + int(descending)


def _block() -> Column:
    return F.shiftright(ROW, BLOCK_BITS)


def _ranges(numbered: DataFrame, number: str, bits: int, rows: Column) -> DataFrame:
    """For each order and part of its numbers: the first number, the rows, and those before it."""
    part = F.shiftright(number, bits)
    counted = numbered.groupBy("ordering", part.alias("part")).agg(
        F.min(number).alias("first"), rows.alias("rows")
    )
    # A row for each task that wrote the numbers.
    order = Window.partitionBy("ordering").orderBy("part")
    before = F.sum("rows").over(order) - F.col("rows")
    return counted.withColumn("before", before).select(*RANGES.names)


def _cells(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cells of all orders, each with its places."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("number"), F.col(f"`{column}`").cast("string").alias("value"))
            for i, column in enumerate(columns)
        ]
    )
    blocks = stored.select(F.explode(entries).alias("entry"), _block().alias("block"))
    counted = tables.settle(
        blocks.select("entry.*", "block")
        .groupBy("number", "value", "block")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    value, nothing = F.col("value"), F.lit(None).cast("string")
    directions = [
        F.struct((2 * F.col("number") + d).alias("ordering"), up.alias("up"), down.alias("down"))
        for d, (up, down) in enumerate(((value, nothing), (nothing, value)))
    ]
    # One sort for all orders: each uses one of the two values.
    both = counted.select(F.explode(F.array(*directions)).alias("entry"), "block", "rows")
    cells = both.select("entry.*", "block", "rows").orderBy(
        "ordering", F.asc_nulls_last("up"), F.desc_nulls_last("down"), "block"
    )
    numbered = cells.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", PART_BITS)
    # The rows of the cells that the same task has sorted before.
    own = Window.partitionBy(part).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.shiftleft(part, PLACE_BITS) + F.sum("rows").over(own)
    return numbered.withColumn("end", end).select(
        "ordering",
        F.coalesce("up", "down").alias("value"),
        "block",
        (F.col("end") - F.col("rows")).alias("place"),
        (F.col("end") - 1).alias("last"),
    )


def write_rows(
    df: DataFrame, path: str, base: Sequence[SortKey], partition_by: str | None = None
) -> DataFrame:
    """Write a table in its base order, with its row numbers, below ``path``; returns the stored rows.

    The keys of ``base`` leave no two rows unordered but equal ones. ``df`` is read more than once:
    hand over a written table.
    """
    sorted_rows = ordered(df, base).withColumn(ROW, F.monotonically_increasing_id())
    writer = sorted_rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/rows")
    # As a page reads it: without a schema, Spark would guess the type of the partition column.
    fields = [f for f in sorted_rows.schema.fields if f.name != partition_by]
    fields += [f for f in sorted_rows.schema.fields if f.name == partition_by]
    return tables.scan(df.sparkSession, f"{path}/rows", T.StructType(fields))


def write_index(stored: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write the index of the rows that ``write_rows`` has stored, for the given columns."""
    cells = tables.replace(_cells(stored, columns), f"{path}/cells")
    rows = stored.select(F.lit(BASE).alias("ordering"), ROW)
    both = _ranges(
        cells, "place", PLACE_BITS, F.sum(F.col("last") - F.col("place") + 1)
    ).unionByName(_ranges(rows, ROW, PART_BITS, F.count(F.lit(1))))
    tables.replace(both.coalesce(1), f"{path}/ranges")


def write_indexed(
    df: DataFrame,
    path: str,
    base: Sequence[SortKey],
    columns: Sequence[str],
    partition_by: str | None = None,
) -> None:
    """Write a table in its base order, and its index below ``path`` for the given columns."""
    write_index(write_rows(df, path, base, partition_by), path, columns)


@dataclass(frozen=True)
class IndexedTable:
    """A table written by ``write_indexed``. ``schema`` is that of its rows."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    schema: T.StructType

    def rows(self) -> DataFrame:
        return tables.scan(self.spark, f"{self.path}/rows", self.schema)

    def _picked(
        self, column: str, ordering: int, stretches: Sequence[tuple[int, int]], few: bool
    ) -> DataFrame:
        """The row numbers at stretches of places. Of few places the cells come to the driver."""
        overlap = [(F.col("place") <= last) & (F.col("last") >= first) for first, last in stretches]
        cells = tables.scan(self.spark, f"{self.path}/cells", CELLS).filter(
            (F.col("ordering") == ordering) & reduce(or_, overlap)
        )
        cells = cells.select(F.col("value").alias("_value"), F.col("block").alias("_block"), "place")
        value = F.col(f"`{column}`").cast("string")
        rows = self.rows()
        if few:
            found = cells.collect()  # a cell has a row of the page
            cells = F.broadcast(self.spark.createDataFrame(found, cells.schema))
            blocks = [
                (first << BLOCK_BITS, (last + 1 << BLOCK_BITS) - 1)
                for first, last in _stretches([r["_block"] for r in found])
            ]
            values = {r["_value"] for r in found}
            named = value.isin(*sorted(values - {None})) if values != {None} else F.lit(False)
            rows = rows.filter(_within(ROW, blocks) & (named | value.isNull() if None in values else named))
        narrow = rows.select(value.alias("value"), _block().alias("block"), ROW)
        same = F.col("value").eqNullSafe(F.col("_value")) & (F.col("block") == F.col("_block"))
        # A block at most of a cell.
        within = Window.partitionBy("place").orderBy(ROW)
        place = F.col("place") + F.row_number().over(within) - 1
        placed = narrow.join(cells, same).select("place", ROW).select(place.alias("place"), ROW)
        return placed.filter(_within("place", stretches))

    def page(
        self, column: str | None, descending: bool, limit: int, offset: int
    ) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` by a column, or in the base order, without ``ROW``."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        ordering = BASE if column is None else numbering(column, self.columns, descending)
        end = offset + limit
        ranges = tables.scan(self.spark, f"{self.path}/ranges", RANGES).filter(
            (F.col("ordering") == ordering)
            & (F.col("before") < end)
            & (F.col("before") + F.col("rows") > offset)
        )
        stretches = [
            (r["first"] + max(offset - r["before"], 0), r["first"] + min(end - r["before"], r["rows"]) - 1)
            for r in ranges.orderBy("before").collect()  # the ranges that hold the page
        ]
        if not stretches or not limit:
            return self.rows().filter(F.lit(False)).drop(ROW)
        if ordering == BASE:
            return self.rows().filter(_within(ROW, stretches)).orderBy(ROW).drop(ROW)
        picked = self._picked(column, ordering, stretches, limit <= NAMED_ROWS)
        rows = self.rows()
        if limit <= NAMED_ROWS:
            found = picked.collect()  # the row numbers of the page
            picked = self.spark.createDataFrame(found, picked.schema)
            rows = rows.filter(_within(ROW, _stretches([r[ROW] for r in found])))
            picked = F.broadcast(picked)
        return rows.join(picked, ROW).orderBy("place").drop("place", ROW)


def _within(column: str, stretches: Sequence[tuple[int, int]]) -> Column:
    return reduce(or_, [F.col(column).between(first, last) for first, last in stretches])


def _stretches(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Few stretches that hold all numbers, cut at the widest gaps."""
    order = sorted(numbers)
    gaps = sorted(range(1, len(order)), key=lambda i: order[i - 1] - order[i])[: STRETCHES - 1]
    cuts = [0, *sorted(gaps), len(order)]
    return [(order[a], order[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
