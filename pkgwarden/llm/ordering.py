"""Contiguous ranges of an ascending id, and the row that follows each row."""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at a time.
ROWS_AT_ONCE = 256


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending ids, taken from the rows, each the first of a range; the smallest id comes first.

    One number a range comes to the driver. Empty where no row has an id.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.min(key), F.percentile_approx(key, shares or [0.5], 100_000)).first()
    return [] if found[0] is None else sorted({found[0], *found[1]})


def range_of(bounds: list[int]):
    """A column function: the number of the range an id lies in; rows without an id come last."""
    firsts = np.array(bounds, np.int64)

    @F.pandas_udf(T.LongType())
    def find(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        plain = ids.fillna(0).astype("int64").to_numpy()
        at = np.maximum(np.searchsorted(firsts, plain, "right") - 1, 0)
        return pd.Series(np.where(missing, max(len(firsts) - 1, 0), at))

    return find


def map_with_next(
    df: DataFrame,
    key: str,
    tie: list[str],
    start: Callable[[tuple], tuple],
    finish: Callable[[tuple, tuple], tuple],
    schema: T.StructType,
) -> DataFrame:
    """One output row for each row and the row after it, in ascending order of a long key.

    ``start`` is called once for a row, ``finish`` with what it made of a row and of the next row.
    After the last row comes the first; rows without a key come last; ``tie`` orders rows of one
    key. Rows are dealt out by ranges of the key, so that no task sees more than its ranges, and
    are streamed: two of them are held at a time. The first row of a range is sent to the range
    before as well. A table without any key is one range.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, key, ranges)
    last = max(len(bounds) - 1, 0)
    at = range_of(bounds)(F.col(key))
    is_first = F.col(key).isin(bounds) if bounds else F.lit(False)
    before = F.when(F.col("_part") == 0, F.lit(last)).otherwise(F.col("_part") - 1)
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("after"))
    ahead = F.struct(before.cast("long").alias("part"), F.lit(1).alias("after"))
    places = F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))
    dealt = (
        df.withColumn("_part", at)
        .withColumn("_place", F.explode(places))
        .select("_place.part", "_place.after", *df.columns)
        .repartition("part")
        .sortWithinPartitions("part", "after", F.col(key).asc_nulls_last(), *tie)
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(part, after, row) in order."""
        for batch in batches:
            # Few rows become Python objects at a time.
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = [c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns]
                for part, after, *row in zip(*columns, strict=True):
                    yield part, after, tuple(row)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, group in itertools.groupby(rows(batches), key=operator.itemgetter(0)):
            held = first = None
            for _, after, row in group:
                if held is None and after:
                    break  # a range of no rows of its own
                made = start(row)
                if held is not None:
                    yield finish(held, made)
                    held = None
                else:
                    first = row
                if after:
                    break
                held = made
            if held is not None:  # the only range of a table without keys
                yield finish(held, start(first))

    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = pairs(batches)
        while found := list(itertools.islice(results, ROWS_AT_ONCE)):
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return dealt.mapInArrow(work, schema)
