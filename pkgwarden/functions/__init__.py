"""Column expressions: no Python runs per row."""

from pkgwarden.functions.safety import FIXED, SAFE, VULNERABLE, safety_status
from pkgwarden.functions.text import (
    archive_package,
    archive_version,
    contains_any,
    strict_date,
)
from pkgwarden.functions.version import (
    register_version_function,
    version_at_least,
    version_key,
    version_key_text,
    version_literal,
)

__all__ = [
    "FIXED",
    "SAFE",
    "VULNERABLE",
    "archive_package",
    "archive_version",
    "contains_any",
    "register_version_function",
    "safety_status",
    "strict_date",
    "version_at_least",
    "version_key",
    "version_key_text",
    "version_literal",
]
