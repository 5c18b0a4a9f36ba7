"""Release metadata, refresh runs and log messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgwarden.functions.text import strict_date
from pkgwarden.operators.filters import with_level
from pkgwarden.operators.ordering import SortKey
from pkgwarden.operators.paging import Page
from pkgwarden.operators.tables import insert_if_absent, now, pivot_keys
from pkgwarden.plans.search import deliver

# The descriptor keys and the columns they fill.
RELEASE_KEYS = {
    "Release": "r_version",
    "Nickname": "nickname",
    "Date": "release_date",
    "Devel": "devel_version",
}

RELEASE_ORDER = [SortKey("release_date", descending=True), SortKey("r_version")]
REFRESH_ORDER = [SortKey("refresh_timestamp", descending=True), SortKey("run_id", descending=True)]
LOG_ORDER = [SortKey("ts"), SortKey("msg")]


def release_info(records: DataFrame) -> DataFrame:
    """The one release that the key/value records describe."""
    return pivot_keys(records, RELEASE_KEYS).withColumn(
        "release_date", strict_date(F.col("release_date"))
    )


def record_release(info: DataFrame, history: DataFrame) -> DataFrame:
    """The release history with the described release added, unless it is known already."""
    added = insert_if_absent(info, history, "r_version", {"detected_at": now()})
    return history.unionByName(added)


def release_history(
    history: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    format: str | None = None,
) -> DataFrame | Page:
    """Known releases, the latest first."""
    # The version of a release is unique, and last in the order.
    return deliver(history, RELEASE_ORDER, limit, offset, format, RELEASE_ORDER, unique=True)


def refresh_log(
    runs: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    format: str | None = None,
) -> DataFrame | Page:
    """Refresh runs, the latest first."""
    # So is the number of a run.
    return deliver(runs, REFRESH_ORDER, limit, offset, format, REFRESH_ORDER, unique=True)


def logs(
    entries: DataFrame,
    level: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    format: str | None = None,
) -> DataFrame | Page:
    """Log entries, of one level if given; raises if a level is given without such a column."""
    return deliver(with_level(entries, level), None, limit, offset, format, LOG_ORDER)


def log_count(entries: DataFrame) -> int:
    """The number of log entries."""
    return entries.count()
