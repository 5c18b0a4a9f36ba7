"""Row-level maintenance: uniqueness, inserts, run numbers, key/value pivot, union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgwarden.operators.joins import rows_absent


class KeyViolation(ValueError):
    """A key is null or occurs twice."""


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key values that are not unique, or null, with their number of rows.

    Each task counts its own rows per key first, so a frequent key costs one row per task.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return counted.filter((F.col("n_rows") > 1) | missing)


def require_unique(df: DataFrame, keys: Sequence[str], table: str) -> None:
    """Raise if the keys of a table are not unique and complete."""
    bad = key_violations(df, keys).take(1)
    if bad:
        raise KeyViolation(f"{table}: {bad[0].asDict()}")


def now() -> Column:
    """Current time without a zone, one value for the whole query."""
    return F.current_timestamp().cast("timestamp_ntz")


def insert_if_absent(
    candidates: DataFrame, existing: DataFrame, key: str, defaults: Mapping[str, Column]
) -> DataFrame:
    """The rows to add to ``existing``: candidates with a new key, completed by the defaults."""
    new = rows_absent(candidates, existing, key)
    return new.withColumns(dict(defaults)).select(*existing.columns)


def next_run(run_log: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """The one row that records the next run: one more than the largest id, and the time."""
    largest = F.coalesce(F.max("run_id"), F.lit(0)).cast("int")
    return (
        run_log.agg((largest + 1).alias("run_id"))
        .withColumns({"refresh_timestamp": now(), **{n: F.lit(v) for n, v in values.items()}})
        .select(*run_log.columns)
    )


def append_run(run_log: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """The run log with the next run added."""
    return run_log.unionByName(next_run(run_log, values))


def log_entry(log: DataFrame, message: str) -> DataFrame:
    """One log row with the current time."""
    one_row = log.sparkSession.range(0, 1, numPartitions=1)
    return one_row.select(now().alias("ts"), F.lit(message).alias("msg"))


def append_message(log: DataFrame, message: str) -> DataFrame:
    """The log with one message added."""
    return log.unionByName(log_entry(log, message))


def pivot_keys(
    records: DataFrame,
    names: Mapping[str, str],
    key: str = "key",
    value: str = "value",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """One column per wanted key, holding the largest trimmed value of that key.

    ``names`` maps keys to output columns. Without ``group_by`` there is exactly one output row,
    all null for empty input. One aggregation, so one exchange of partly aggregated rows.
    """
    columns = [
        F.max(F.when(F.col(key) == wanted, F.trim(value))).alias(name)
        for wanted, name in names.items()
    ]
    if group_by:
        return records.groupBy(*group_by).agg(*columns)
    # Other keys cannot change the one row, so they need not be read.
    return records.filter(F.col(key).isin(*names)).agg(*columns)


def union_padded(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both frames; columns that the second lacks are null there."""
    for field in first.schema.fields:
        if field.name not in second.columns:
            second = second.withColumn(field.name, F.lit(None).cast(field.dataType))
    return first.unionByName(second.select(*first.columns))


def count_rows(df: DataFrame) -> DataFrame:
    """The number of rows, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n"))
