"""Which files of a stored table may hold a text: the trigrams of each file and column.

A row whose column contains a term, in any case, contains all runs of three characters of the term in that
column. The table of these runs by file is written with the data; a search reads the files that hold
all of its term's runs in one column, and still compares every row it reads. Terms of fewer
than three characters, or with wildcards, read everything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources import tables

RUN = 3
WILDCARDS = "%_"
#: A search that more files may answer than this reads the whole table.
NAMED_FILES = 10_000

GRAMS = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("file", T.StringType()),
    ]
)


def runs_of(text: str) -> set[str]:
    """All runs of three characters."""
    return {text[i : i + RUN] for i in range(len(text) - RUN + 1)}


def runs_in(texts: Iterable[str]) -> set[str]:
    """All runs of three characters of any text, without a set for each text."""
    found: set[tuple[str, ...]] = set()
    for text in texts:
        found.update(zip(*(text[i:] for i in range(RUN)), strict=False))
    return set(map("".join, found))


def write_skip_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write the runs of the columns of a stored frame, by file, in the order of the runs."""
    lowered = [F.lower(F.col(f"`{c}`").cast("string")).alias(c) for c in columns]
    stored = df.select(F.col("_metadata.file_path").alias("_file"), *lowered)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for file, rows in frame.groupby("_file"):
                for column in columns:
                    # Values occur often; each is cut once in a batch.
                    found = runs_in(rows[column].dropna().unique())
                    if found:
                        yield pd.DataFrame({"gram": sorted(found), "column": column, "file": file})

    grams = stored.mapInPandas(collect, GRAMS).distinct()
    tables.replace(grams.orderBy("gram", "column", "file"), path)


@dataclass(frozen=True)
class SkipTable:
    """The skip table written at a path."""

    spark: SparkSession
    path: str

    def files(self, term: str | None) -> list[str] | None:
        """The files that may hold a term, or none where that cannot be told or is of no use."""
        if not term or any(c in term for c in WILDCARDS):
            return None
        # As the comparison lowers it.
        lowered = self.spark.range(1).select(F.lower(F.lit(term))).first()[0]
        wanted = runs_of(lowered)
        if not wanted:
            return None
        held = tables.scan(self.spark, self.path, GRAMS).filter(F.col("gram").isin(*wanted))
        counted = held.groupBy("file", "column").agg(F.count(F.lit(1)).alias("n"))
        whole = counted.filter(F.col("n") == len(wanted)).select("file").distinct()
        found = [row["file"] for row in whole.limit(NAMED_FILES + 1).collect()]
        return sorted(found) if len(found) <= NAMED_FILES else None
