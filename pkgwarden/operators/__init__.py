"""DataFrame operators."""

from pkgwarden.operators.filters import all_of, status_is, wanted_status, with_level
from pkgwarden.operators.joins import (
    JoinLimits,
    Size,
    lookup_join,
    measure,
    rows_absent,
)
from pkgwarden.operators.ordering import SortKey, ordered, ordered_whole, total_order
from pkgwarden.operators.paging import Page, page, paged
from pkgwarden.operators.spread import spread_stored, with_spread
from pkgwarden.operators.tables import (
    KeyViolation,
    append_message,
    append_run,
    count_rows,
    insert_if_absent,
    key_violations,
    pivot_keys,
    require_unique,
    union_padded,
)

__all__ = [
    "JoinLimits",
    "KeyViolation",
    "Page",
    "Size",
    "SortKey",
    "all_of",
    "append_message",
    "append_run",
    "count_rows",
    "insert_if_absent",
    "key_violations",
    "lookup_join",
    "measure",
    "ordered",
    "ordered_whole",
    "page",
    "paged",
    "pivot_keys",
    "require_unique",
    "rows_absent",
    "spread_stored",
    "status_is",
    "total_order",
    "union_padded",
    "wanted_status",
    "with_level",
    "with_spread",
]
