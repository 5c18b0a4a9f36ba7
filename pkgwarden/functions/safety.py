"""Safety status of a package version against one advisory range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three statuses.
SAFE = "SAFE"
FIXED = "FIXED"
VULNERABLE = "VULNERABLE"


def safety_status(
    osv_id: Column, version_key: Column, introduced_key: Column, fixed_key: Column
) -> Column:
    """A version that has reached the fix is fixed, even when it never reached the introduction.

    A null key compares as unknown and so never counts as reached; without an advisory id the
    version is safe.
    """
    advised = osv_id.isNotNull()
    reached_fix = advised & (version_key >= fixed_key)
    reached_introduction = advised & (version_key >= introduced_key)
    return (
        F.when(reached_fix, F.lit(FIXED))
        .when(reached_introduction, F.lit(VULNERABLE))
        .otherwise(F.lit(SAFE))
    )
