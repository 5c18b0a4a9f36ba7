"""What one task reads of a file, and records that lie in several such splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits of a file may differ between two readings (their size depends on the cores that a cluster has
#: at the time), which is noticed; so often the states are counted anew.
ATTEMPTS = 3

#: Kinds of pieces: a whole record; what a split begins with of a record before, and ends with of one that
#: goes on; a file that must be read otherwise; a split that was not there before.
RECORD, HEAD, TAIL, IRREGULAR, MOVED = range(5)


class SplitsMoved(RuntimeError):
    """The splits of the files differ each time they are read."""


def lines_with_splits(spark: SparkSession, path: str | Sequence[str], end: str) -> DataFrame:
    """Lines (``value``) without what ends them, with the split that each is in: ``file, start, length``."""
    meta = F.col("_metadata")
    paths = path if isinstance(path, str) else list(path)
    return spark.read.option("lineSep", end).text(paths).select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        meta["file_block_length"].alias("length"),
        "value",
    )


def assembled(pieces: DataFrame, joiner: str, flags: Sequence[str] = ()) -> DataFrame:
    """Records that lie in several splits: ``file``, the flags and ``text``.

    A tail begins one, and the heads up to the next tail go on with it.
    """
    broken = pieces.filter(F.col("kind").isin(HEAD, TAIL))
    order = Window.partitionBy("file").orderBy("start", "kind")
    # Two rows a split at most, without their texts.
    numbered = broken.select("file", "start", "kind").withColumn(
        "number", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    return (
        broken.join(numbered, ["file", "start", "kind"])
        .groupBy("file", "number")
        .agg(*[F.max(flag).alias(flag) for flag in flags], parts.alias("parts"))
        .select("file", *flags, F.array_join(F.col("parts")["text"], joiner).alias("text"))
    )
