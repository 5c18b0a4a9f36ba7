"""Feed readers and stored tables."""

from pkgwarden.sources.feeds import (
    feed_path,
    read_advisories,
    read_archive,
    read_catalogue,
    read_delimited,
    read_key_values,
)
from pkgwarden.sources.tables import append, create_if_missing, replace, scan

__all__ = [
    "append",
    "create_if_missing",
    "feed_path",
    "read_advisories",
    "read_archive",
    "read_catalogue",
    "read_delimited",
    "read_key_values",
    "replace",
    "scan",
]
