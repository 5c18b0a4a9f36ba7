"""Package-vulnerability analytics as Spark DataFrame plans."""

from pkgwarden.plans.refresh import Feeds, PackageStore, PublishedVersion
from pkgwarden.plans.safety import package_safety_report, packages_search
from pkgwarden.plans.search import search_packages, search_view
from pkgwarden.session import build_session

__all__ = [
    "Feeds",
    "PackageStore",
    "PublishedVersion",
    "build_session",
    "package_safety_report",
    "packages_search",
    "search_packages",
    "search_view",
]
