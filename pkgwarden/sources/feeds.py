"""Readers for the raw feeds: delimited text, nested JSON documents and key/value JSON.

A malformed record or a missing path raises; nothing is skipped silently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources import split_csv, split_json
from pkgwarden.sources.schemas import (
    ADVISORY,
    ARCHIVE_TEXT,
    CATALOGUE_TEXT,
    KEY_VALUE,
)


def feed_path(base_dir: str, file: str) -> str:
    """Path of a feed file below the base directory."""
    return f"{base_dir.rstrip('/')}/{file.lstrip('/')}"


def read_delimited(
    spark: SparkSession,
    path: str,
    text_columns: Collection[str] = (),
    schema: T.StructType | None = None,
    delimiter: str = ";",
    quote: str = '"',
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text with a header line and doubled quotes inside quoted fields.

    ``text_columns`` stay text; the type of every other column is inferred unless ``schema`` gives all
    types. A given schema must have the text columns, as text.

    By default the files are looked through for quoted fields that hold line breaks. Files without any
    are split freely; of the others the records are cut out split by split and written once, so a file
    is read twice, each time by all its splits (see ``split_csv``). ``multi_line`` saves the look:
    false for no such fields, true to read every file unsplit.
    """

    def reader(unsplit: bool) -> DataFrameReader:
        return spark.read.options(
            sep=delimiter, quote=quote, escape=quote, header=True, mode="FAILFAST",
            multiLine=unsplit,
        )

    if schema is not None:
        kinds = {f.name: f.dataType for f in schema.fields}
        wrong = sorted(n for n in text_columns if not isinstance(kinds.get(n), T.StringType))
        if wrong:
            raise ValueError(f"columns {wrong} must be text in the schema of {path}")

    def completed(names: list[str], infer: Callable[[], T.StructType]) -> T.StructType:
        if schema is not None:
            return schema
        absent = sorted(set(text_columns) - set(names))
        if absent:
            raise ValueError(f"columns {absent} are not in {path}: {names}")
        if set(names) <= set(text_columns):
            return T.StructType([T.StructField(name, T.StringType()) for name in names])
        return T.StructType(
            [
                T.StructField(f.name, T.StringType() if f.name in text_columns else f.dataType)
                for f in infer()
            ]
        )

    def plain(paths: str | list[str], unsplit: bool, wanted: T.StructType | None) -> DataFrame:
        if wanted is None:
            wanted = completed(
                reader(unsplit).csv(paths).schema.names,
                lambda: reader(unsplit).options(inferSchema=True).csv(paths).schema,
            )
        return reader(unsplit).options(enforceSchema=False).schema(wanted).csv(paths)

    if multi_line is not None:
        return plain(path, multi_line, None)
    known = split_csv.splits(spark, path, quote)
    long = sorted({s.file for s in known if s.long})
    short = sorted({s.file for s in known} - set(long))
    if not long:
        return plain(path, False, None)
    options = {
        "sep": delimiter, "quote": quote, "escape": quote, "mode": "FAILFAST", "multiLine": "true"
    }
    records, irregular = split_csv.read_records(spark, long, known, delimiter, quote)
    if irregular or short:
        # Types must hold for all files: they are inferred by one reader.
        others = [([unquote(f) for f in short], False), ([unquote(f) for f in irregular], True)]
        wanted = completed(
            reader(True).csv(path).schema.names,
            lambda: reader(True).options(inferSchema=True).csv(path).schema,
        )
    else:
        others = []
        names = split_csv.header_names(records, delimiter, quote)
        wanted = completed(names, lambda: split_csv.inferred(records, names, options))
    frames = [plain(files, unsplit, wanted) for files, unsplit in others if files]
    if len(irregular) < len(long):
        names = split_csv.header_names(records, delimiter, quote)
        if names != wanted.names:
            raise ValueError(f"the header of {path} is {names}, not {wanted.names}")
        frames.append(split_csv.parsed(records, wanted, options))
    return reduce(DataFrame.unionByName, frames)


def read_catalogue(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Current packages, one row each; columns beyond the named ones pass through."""
    return read_delimited(spark, path, CATALOGUE_TEXT, schema, multi_line=multi_line)


def read_archive(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Archived package files, one row each."""
    return read_delimited(spark, path, ARCHIVE_TEXT, schema, multi_line=multi_line)


def _size_in_bytes(setting: str) -> int:
    """A size as Spark's settings have it, such as ``128m`` or ``134217728b``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit not in ("", "b") else " ")


def _read_json(
    spark: SparkSession, path: str, schema: T.StructType, one_record_per_line: bool
) -> DataFrame:
    def plain(paths: str | list[str], whole: bool) -> DataFrame:
        return spark.read.schema(schema).json(paths, multiLine=whole, mode="FAILFAST")

    if one_record_per_line:
        return plain(path, False)
    # Only names and sizes are listed. A file of more than a split's size is worth splitting.
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    most = _size_in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    large = sorted(r["path"] for r in listed.filter(F.col("length") > most).collect())
    if not large:
        return plain(path, True)
    elements, irregular = split_json.read_elements(spark, large)
    frames = [split_json.parsed(elements, schema)] if len(irregular) < len(large) else []
    small = sorted(r["path"] for r in listed.filter(F.col("length") <= most).collect())
    frames += [plain(files, True) for files in (small, irregular) if files]
    return reduce(DataFrame.unionByName, frames)


def read_advisories(
    spark: SparkSession, path: str, one_record_per_line: bool = False
) -> DataFrame:
    """Advisory documents, normally one file each; ``path`` may be a glob.

    A feed delivered as JSON lines (``one_record_per_line``) can be split within a file, and so is an
    array of documents in a file larger than a split (see ``split_json``).
    """
    return _read_json(spark, path, ADVISORY, one_record_per_line)


def read_key_values(
    spark: SparkSession, path: str, one_record_per_line: bool = False
) -> DataFrame:
    """Records of a key and a value, as a JSON array or as JSON lines."""
    return _read_json(spark, path, KEY_VALUE, one_record_per_line)
