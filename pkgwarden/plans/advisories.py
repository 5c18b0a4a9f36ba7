"""From advisory documents to one lookup row per package and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgwarden.functions.version import version_key

DEFAULT_ECOSYSTEM = "CRAN"


def flatten_advisories(documents: DataFrame, ecosystem: str = DEFAULT_ECOSYSTEM) -> DataFrame:
    """One row per version range of each package of the ecosystem.

    Documents without affected packages, and packages without ranges, give no row.
    """
    affected = documents.select(F.col("id").alias("osv_id"), F.explode("affected").alias("entry"))
    return affected.filter(F.col("entry.package.ecosystem") == F.lit(ecosystem)).select(
        "osv_id",
        F.col("entry.package.name").alias("Package"),
        F.explode("entry.ranges.events").alias("events"),
    )


def _first_value(events: Column, field: str) -> Column:
    """The field of the first event that has it, or null."""
    return F.get(F.filter(events, lambda e: e[field].isNotNull()), 0)[field]


def vulnerability_lookup(flat: DataFrame) -> DataFrame:
    """The first introduced and the first fixed version of every range."""
    return flat.select(
        "Package",
        "osv_id",
        _first_value(F.col("events"), "introduced").alias("introduced_v"),
        _first_value(F.col("events"), "fixed").alias("fixed_v"),
    )


def with_version_keys(lookup: DataFrame) -> DataFrame:
    """The lookup with comparable keys of its two versions, computed once per range."""
    return lookup.withColumns(
        {
            "introduced_key": version_key(F.col("introduced_v")),
            "fixed_key": version_key(F.col("fixed_v")),
        }
    )
