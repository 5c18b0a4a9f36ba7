"""Chunked delivery of a finished result as line-delimited JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a time without zone is written, with its microseconds. Null fields are left
# out of the JSON objects, which is Spark's default.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in a column ``json``."""
    return df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("json"))


def write_ndjson(df: DataFrame, path: str) -> None:
    """Write the whole result as JSON lines, one file per partition.

    An ordered frame gives files whose names sort in that order.
    """
    df.write.options(**JSON_OPTIONS).json(path)


def stream_ndjson(df: DataFrame) -> Iterator[str]:
    """The JSON lines one partition at a time, for a caller that reads them one by one."""
    for row in json_rows(df).toLocalIterator():
        yield row["json"]
