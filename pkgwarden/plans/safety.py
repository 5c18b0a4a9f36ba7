"""Catalogue, archive and advisories combined into classified package versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgwarden.functions.safety import FIXED, VULNERABLE, safety_status
from pkgwarden.functions.text import archive_package, archive_version
from pkgwarden.functions.version import version_key
from pkgwarden.operators.filters import wanted_status
from pkgwarden.operators.joins import DEFAULT_LIMITS, JoinLimits, Size, lookup_join
from pkgwarden.operators.tables import union_padded
from pkgwarden.plans.advisories import with_version_keys

VERSION_KEY = "version_key"

# The columns of the two relations, in their order.
REPORT_COLUMNS = (
    "Package",
    "Version",
    "Title",
    "Description",
    "Published",
    "status",
    "osv_id",
    "osv_safety_status",
)
SEARCH_COLUMNS = (
    "Package",
    "Title",
    "Description",
    "Published",
    "Version",
    "License",
    "status",
    "osv_id",
    "osv_safety_status",
)


def parse_archive(archive: DataFrame) -> DataFrame:
    """The archive listing with the package and the version that the file names carry."""
    return archive.withColumns(
        {
            "Package": archive_package(F.col("file_name")),
            "Version": archive_version(F.col("file_name")),
        }
    )


def current_packages(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows tagged as current."""
    return catalogue.withColumn("status", F.lit("current"))


def archived_packages(archive: DataFrame) -> DataFrame:
    """Archive rows tagged as archived; parses the file names unless that is done already."""
    parsed = archive if "Package" in archive.columns else parse_archive(archive)
    return parsed.withColumn("status", F.lit("archived"))


def all_packages(catalogue: DataFrame, archive: DataFrame) -> DataFrame:
    """Current and archived package versions; archived ones have no descriptive columns.

    Version keys are kept if both inputs have them stored.
    """
    keys = [VERSION_KEY] if {VERSION_KEY} <= set(catalogue.columns) & set(archive.columns) else []
    current = current_packages(catalogue).select(
        "Package", "Version", "Title", "Description", "Published", "status", *keys
    )
    archived = archived_packages(archive).select("Package", "Version", "status", *keys)
    return union_padded(current, archived)


def classify(
    packages: DataFrame,
    lookup: DataFrame,
    status: str | None = None,
    size: Size | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Package versions with every advisory range of their package, and the safety status.

    ``status`` may be in any case; an empty one and ``ALL`` are no filter.
    A package without advisory keeps one row. ``status`` keeps the rows of one status: a fixed or
    vulnerable row always has an advisory, so an inner join with the ranges that can give this
    status is enough. Version keys stored with the inputs are used; otherwise a row's key is
    computed once, and only where an advisory matched.
    """
    status = wanted_status(status)
    if "fixed_key" not in lookup.columns:
        lookup = with_version_keys(lookup)
    how = "left"
    if status in (FIXED, VULNERABLE):
        how = "inner"
        reachable = "fixed_key" if status == FIXED else "introduced_key"
        possible = F.col("osv_id").isNotNull() & F.col(reachable).isNotNull()
        lookup = lookup.filter(possible)
    lookup = lookup.drop("introduced_v", "fixed_v")
    joined = lookup_join(packages, lookup, "Package", how, size, limits)
    if VERSION_KEY not in packages.columns:
        needed = F.when(F.col("osv_id").isNotNull(), F.col("Version"))
        joined = joined.withColumn(VERSION_KEY, version_key(needed))
    found = safety_status(
        F.col("osv_id"), F.col(VERSION_KEY), F.col("introduced_key"), F.col("fixed_key")
    )
    classified = joined.withColumn("osv_safety_status", found).drop(
        VERSION_KEY, "introduced_key", "fixed_key"
    )
    return classified if status is None else classified.filter(F.col("osv_safety_status") == status)


def package_safety_report(
    catalogue: DataFrame,
    archive: DataFrame,
    lookup: DataFrame,
    status: str | None = None,
    size: Size | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Every current and archived version with its advisories and safety status."""
    packages = all_packages(catalogue, archive)
    return classify(packages, lookup, status, size, limits).select(*REPORT_COLUMNS)


def packages_search(
    catalogue: DataFrame,
    lookup: DataFrame,
    status: str | None = None,
    size: Size | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Current packages with licence, advisories and safety status."""
    packages = current_packages(catalogue)
    return classify(packages, lookup, status, size, limits).select(*SEARCH_COLUMNS)
