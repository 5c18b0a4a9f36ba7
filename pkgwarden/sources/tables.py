"""Stored tables: create if missing, replace, append, scan, and scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources import files
from pkgwarden.sources.schemas import DEFAULT


_local_dirs: dict[str, str] = {}
_scratch_paths: dict[str, list[str]] = {}


def create_if_missing(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Write an empty table unless something is stored at the path already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or no rows where nothing is stored; writes nothing."""
    try:
        return scan(spark, path, schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Store the frame as the whole content of the table and return the stored table.

    The path must not be one that ``df`` reads: stage into a new directory instead.
    """
    df.write.mode("overwrite").parquet(path)
    return scan(df.sparkSession, path, df.schema)


def declared_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a stored table with the defaults it declares, or none where nothing is stored."""
    try:
        return scan(spark, path).schema
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Add rows to a table, creating it if missing.

    A table keeps the defaults that its schema declares (``schemas.defaulted``), so a writer may leave
    columns out without naming them: they get their default, or null where none is declared. Columns
    that the table does not have are refused. ``schema`` is that of a table that is not stored yet;
    without one the rows' own is taken.
    """
    schema = declared_schema(df.sparkSession, path) or schema or df.schema
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"columns {unknown} are not in the table: {schema.names}")

    def value(field: T.StructField) -> Column:
        if field.name in df.columns:
            return F.col(f"`{field.name}`")
        return F.expr(field.metadata.get(DEFAULT, "NULL"))

    columns = [value(f).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    df.select(*columns).write.mode("append").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by the session.

    Where the session names none, only a local session gets one (a new temporary folder).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="pkgwarden-")
    return _local_dirs[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never handed out before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch_paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to scratch space; frames that read it end.

    Returns the number of paths that held something.
    """
    paths = _scratch_paths.pop(spark.sparkContext.applicationId, [])
    return sum(files.delete(spark, path) for path in paths)


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to scratch space once and go on from the written rows.

    Rows numbered or salted at random are fixed by this: a task that is run again after a lost
    executor reads the same values.
    """
    return replace(df, scratch_path(df.sparkSession, "settled"))
