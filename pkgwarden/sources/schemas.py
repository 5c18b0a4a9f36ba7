"""Schemas of the feeds and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DATE, TIME = T.StringType(), T.DateType(), T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Key of a column's metadata that holds its default, as SQL text. Parquet keeps the metadata.
DEFAULT = "default"


def defaulted(schema: T.StructType, **defaults: str) -> T.StructType:
    """A schema whose columns of these names declare a default."""
    return T.StructType(
        [
            T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, DEFAULT: defaults[f.name]})
            if f.name in defaults
            else f
            for f in schema.fields
        ]
    )


# The fields of the feeds and of the stored tables.
_RANGE = struct(events=T.ArrayType(struct(introduced=STRING, fixed=STRING)))
_AFFECTED = struct(package=struct(name=STRING, ecosystem=STRING), ranges=T.ArrayType(_RANGE))
ADVISORY = struct(id=STRING, affected=T.ArrayType(_AFFECTED))

KEY_VALUE = struct(key=STRING, value=STRING)

_NOW = "current_timestamp()"

RELEASE_HISTORY = defaulted(
    struct(
        r_version=STRING,
        nickname=STRING,
        release_date=DATE,
        devel_version=STRING,
        detected_at=TIME,
    ),
    detected_at=_NOW,
)

REFRESH_LOG = defaulted(
    struct(
        run_id=T.IntegerType(),
        refresh_timestamp=TIME,
        cran_packages_source=STRING,
        cran_archive_source=STRING,
        osv_source_pattern=STRING,
        status=STRING,
    ),
    refresh_timestamp=_NOW,
)

LOGS = defaulted(struct(ts=TIME, msg=STRING), ts=_NOW)

# Feed columns that are always text, whatever their values look like: a version such as 1.10 read
# as a number would lose its last digit.
CATALOGUE_TEXT = (
    "Package",
    "Version",
    "Title",
    "Description",
    "Published",
    "License",
    "Date/Publication",
)
ARCHIVE_TEXT = ("file_name", "size")
