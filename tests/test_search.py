"""Search parameters and the properties that tie the results together."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import feed_mapping as feeds
from pkgwarden.operators import JoinLimits, status_is, wanted_status, with_level
from pkgwarden.plans import records
from pkgwarden.plans.advisories import flatten_advisories, vulnerability_lookup, with_version_keys
from pkgwarden.plans.safety import package_safety_report, packages_search
from pkgwarden.plans.search import search_packages, search_view, sort_keys

SF = "/root/testdata/sf0.001"


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def inputs(spark):
    catalogue = feeds.catalogue(spark, SF)
    lookup = entry.advisory_lookup(spark, SF)
    return catalogue, lookup


def keys(*arguments):
    return [(k.column, k.descending) for k in sort_keys(*arguments)]


def test_sort_parameters():
    rest = [("Package", False), ("Version", False), ("osv_id", False)]
    assert keys() == rest
    assert keys("VERSION", "DESC") == [("Version", True), ("Package", False), ("osv_id", False)]
    assert keys("license", None)[0] == ("License", False)
    assert keys("maintainer", "desc") == [("Package", True), ("Version", False), ("osv_id", False)]
    assert keys("title", "downwards")[0] == ("Title", False)


@pytest.mark.parametrize(
    ("status", "expected"),
    [(None, None), ("", None), ("all", None), ("ALL", None), ("fixed", "FIXED"), ("x", "X")],
)
def test_wanted_status(status, expected):
    assert wanted_status(status) == expected
    assert (status_is("s", None) is None) is True


def test_status_filters_add_up_to_the_whole(inputs):
    whole = search_packages(*inputs).total
    parts = [search_packages(*inputs, status=s).total for s in ("safe", "FIXED", "Vulnerable")]
    assert sum(parts) == whole
    assert all(parts)
    assert search_packages(*inputs, status="unknown").total == 0


@pytest.mark.parametrize("status", ["SAFE", "FIXED", "VULNERABLE"])
def test_status_plan_gives_the_filtered_report(spark, inputs, status):
    catalogue, lookup = inputs
    archive = feeds.archive(spark, SF)
    whole = package_safety_report(catalogue, archive, lookup)
    part = package_safety_report(catalogue, archive, lookup, status)
    assert multiset(part) == multiset(whole.filter(F.col("osv_safety_status") == status))


def test_fixed_and_vulnerable_use_an_inner_join(inputs, plan_of):
    assert "Inner" in plan_of(packages_search(*inputs, status="FIXED"))
    assert "LeftOuter" in plan_of(packages_search(*inputs, status="SAFE"))


def test_catalogue_is_not_shuffled(inputs, plan_of):
    assert "Exchange hashpartitioning" not in plan_of(packages_search(*inputs))


def test_report_beyond_the_broadcast_limit(spark, inputs):
    catalogue, lookup = inputs
    archive = feeds.archive(spark, SF)
    limits = JoinLimits(broadcast_rows=0, cell_rows=1)
    assert multiset(package_safety_report(catalogue, archive, lookup, limits=limits)) == multiset(
        package_safety_report(catalogue, archive, lookup)
    )


def test_several_ranges_multiply_rows_and_the_total(spark):
    catalogue = spark.createDataFrame(
        [("p", "t", "d", "2024", "1.5", "MIT"), ("q", None, None, None, "1", None)],
        "Package string, Title string, Description string, Published string, Version string,"
        " License string",
    )
    documents = spark.sql(
        """SELECT 'A' AS id, array(
             named_struct('package', named_struct('name', 'p', 'ecosystem', 'CRAN'), 'ranges',
               array(named_struct('events', array(
                       named_struct('introduced', '1', 'fixed', CAST(NULL AS STRING)),
                       named_struct('introduced', '3', 'fixed', '1.4'),
                       named_struct('introduced', NULL, 'fixed', '9'))),
                     named_struct('events', array(
                       named_struct('introduced', '1.2', 'fixed', CAST(NULL AS STRING)))))),
             named_struct('package', named_struct('name', 'q', 'ecosystem', 'PyPI'), 'ranges',
               array(named_struct('events', array(
                       named_struct('introduced', '0', 'fixed', CAST(NULL AS STRING))))))
           ) AS affected"""
    )
    lookup = vulnerability_lookup(flatten_advisories(documents))
    assert multiset(lookup) == Counter([("p", "A", "1", "1.4"), ("p", "A", "1.2", None)])
    found = search_packages(catalogue, with_version_keys(lookup))
    assert found.total == 3
    rows = [(r["Package"], r["osv_id"], r["osv_safety_status"]) for r in found.rows.collect()]
    assert Counter(rows) == Counter(
        [("p", "A", "FIXED"), ("p", "A", "VULNERABLE"), ("q", None, "SAFE")]
    )
    assert search_packages(catalogue, lookup, status="vulnerable").total == 1
    other = vulnerability_lookup(flatten_advisories(documents, "PyPI"))
    assert multiset(other) == Counter([("q", "A", "0", None)])


def test_missing_and_empty_lists_give_no_row(spark):
    documents = spark.sql(
        """SELECT id, IF(id = 'null', NULL, IF(id = 'empty', array(), array(
             named_struct('package', named_struct('name', 'p', 'ecosystem', 'CRAN'), 'ranges',
               IF(id = 'no ranges', NULL, array(named_struct('events',
                 IF(id = 'no events', NULL, array(
                   named_struct('introduced', '0', 'fixed', '1')))))))))) AS affected
           FROM VALUES ('null'), ('empty'), ('no ranges'), ('no events'), ('full') AS t(id)"""
    )
    lookup = vulnerability_lookup(flatten_advisories(documents))
    assert multiset(lookup) == Counter(
        [("p", "no events", None, None), ("p", "full", "0", "1")]
    )


def test_license_is_not_searched(inputs):
    catalogue, lookup = inputs
    marked = catalogue.withColumn("License", F.lit("onlyhere"))
    assert search_packages(marked, lookup, term="onlyhere").total == 0


def test_ndjson_ignores_paging_and_only_the_exact_name_counts(inputs):
    whole = search_packages(*inputs, format="ndjson", limit=1, offset=5)
    assert whole.count() == search_packages(*inputs).total
    assert search_packages(*inputs, format="NDJSON", limit=1).rows.count() == 1


def test_default_limit_and_order(inputs):
    found = search_packages(*inputs)
    assert (found.limit, found.offset) == (100, 0)
    names = [r["Package"] for r in found.rows.collect()]
    assert len(names) == 100
    assert names == sorted(names)


def test_view_and_lazy_search_agree(inputs):
    view = packages_search(*inputs)
    arguments = {"term": "a", "sort_by": "title", "sort_order": "desc", "limit": 40}
    assert (
        search_view(view, **arguments).rows.collect()
        == search_packages(*inputs, **arguments).rows.collect()
    )


def test_level_needs_a_level_column(spark):
    log = spark.createDataFrame([("a",)], "msg string")
    assert with_level(log, None).count() == 1
    with pytest.raises(Exception, match="level"):
        records.logs(log.withColumn("ts", F.current_timestamp()), level="error")
