"""Search, sort and page the classified packages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pkgwarden.functions.text import contains_any
from pkgwarden.operators.filters import all_of, status_is, wanted_status
from pkgwarden.operators.joins import DEFAULT_LIMITS, JoinLimits, Size
from pkgwarden.operators.ordering import SortKey, ordered_whole
from pkgwarden.operators.paging import DEFAULT_LIMIT, DEFAULT_OFFSET, Page, paged
from pkgwarden.operators.spread import SPREAD
from pkgwarden.plans.safety import packages_search

# The columns that a search term is looked up in, the columns that a caller may
# sort by, and the format name that asks for the whole result as JSON lines.
SEARCHED = (
    "Package",
    "Title",
    "Description",
    "Published",
    "Version",
    "status",
    "osv_id",
    "osv_safety_status",
)
SORTABLE = (
    "Package",
    "Version",
    "License",
    "Published",
    "Title",
    "status",
    "osv_id",
    "osv_safety_status",
)
NDJSON = "ndjson"

# The order of a result that the caller left unsorted, and of equal sort values.
DEFAULT_ORDER = ("Package", "Version", "osv_id")


def sort_keys(sort_by: str | None = None, sort_order: str | None = None) -> list[SortKey]:
    """The caller's sort column, completed by the default order.

    Names are compared without case; an unknown column sorts by package, and any direction but
    ``desc`` is ascending.
    """
    names = {name.lower(): name for name in SORTABLE}
    keys = []
    if sort_by is not None:
        column = names.get(sort_by.lower(), "Package")
        keys.append(SortKey(column, (sort_order or "").lower() == "desc"))
    chosen = {key.column for key in keys}
    return keys + [SortKey(name) for name in DEFAULT_ORDER if name not in chosen]


def matching(
    searchable: DataFrame, term: str | None = None, status: str | None = None
) -> DataFrame:
    """Rows that hold the term in one of the searched columns and have the wanted status."""
    return searchable.filter(
        all_of(
            [
                None if term is None else contains_any(SEARCHED, term),
                status_is("osv_safety_status", status),
            ]
        )
    )


def deliver(
    df: DataFrame,
    keys: list[SortKey] | None,
    limit: int | None,
    offset: int | None,
    format: str | None,
    default_order: list[SortKey],
    total: int | None = None,
    stored: bool = False,
    unique: bool = False,
) -> DataFrame | Page:
    """A page with its total, or for ``ndjson`` the whole result, ordered if keys are given.

    ``total`` is the number of rows if known; ``stored`` says that the frame reads stored rows,
    ``unique`` that no two rows are equal in the keys.
    """
    if format == NDJSON:
        return df.drop(SPREAD) if keys is None else ordered_whole(df, keys, unique)
    return paged(
        df.drop(SPREAD),
        default_order if keys is None else keys,
        DEFAULT_LIMIT if limit is None else limit,
        DEFAULT_OFFSET if offset is None else offset,
        total,
        stored,
    )


def search_view(
    searchable: DataFrame,
    term: str | None = None,
    status: str | None = None,
    sort_by: str | None = None,
    sort_order: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    format: str | None = None,
    total: int | None = None,
    stored: bool = False,
) -> DataFrame | Page:
    """Search an already classified frame with the columns of ``packages_search``.

    Returns a page with the total number of matches, or every match when ``format`` is
    ``ndjson`` (limit and offset do not apply then).
    """
    found = matching(searchable, term, status)
    keys = None if sort_by is None else sort_keys(sort_by, sort_order)
    return deliver(found, keys, limit, offset, format, sort_keys(), total, stored)


def search_packages(
    catalogue: DataFrame,
    lookup: DataFrame,
    term: str | None = None,
    status: str | None = None,
    sort_by: str | None = None,
    sort_order: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    format: str | None = None,
    size: Size | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame | Page:
    """Classify the catalogue and search it, see ``search_view``."""
    searchable = packages_search(catalogue, lookup, wanted_status(status), size, limits)
    return search_view(searchable, term, status, sort_by, sort_order, limit, offset, format)
