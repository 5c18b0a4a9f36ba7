"""Case-insensitive substring search and archive-name parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# LIKE needs some escape character; this one never occurs in a search term, so that backslashes
# in a term are plain text while ``%`` and ``_`` stay wildcards.
LIKE_ESCAPE = "\u0001"

# How an archive path names its version. ``\z`` is the very end of the text (``$``
# would also match before a trailing newline).
ARCHIVE_VERSION = r"_([0-9.-]+)\.tar\.gz\z"


def contains_any(columns: Sequence[str], term: str) -> Column:
    """True where at least one of the columns contains the term, ignoring case.

    Null columns neither match nor prevent a match. An empty term matches every row that has a
    value in one of the columns.
    """
    if LIKE_ESCAPE in term:
        raise ValueError("a search term must not contain the character U+0001")
    pattern = F.lit(f"%{term}%")
    return reduce(or_, [F.ilike(F.col(c), pattern, F.lit(LIKE_ESCAPE)) for c in columns])


def archive_package(file_name: Column) -> Column:
    """Package part of an archive path: the text up to the first slash, which may be empty."""
    return F.substring_index(file_name, "/", 1)


def archive_version(file_name: Column) -> Column:
    """Version part of an archive path; ``''`` if the name carries none."""
    return F.regexp_extract(file_name, ARCHIVE_VERSION, 1)


def strict_date(text: Column) -> Column:
    """Date from ``yyyy-mm-dd`` text; any other non-null text raises, whatever the ANSI setting."""
    parsed = F.when(text.rlike(r"^\d{4,}-\d{1,2}-\d{1,2}\z"), text.try_cast("date"))
    return F.when(
        text.isNotNull(),
        F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")),
    )
