"""Pages read by the index against pages of the sorted frame."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pkgwarden import PackageStore
from pkgwarden.operators import SortKey, ordered, total_order
from pkgwarden.operators import rank_index
from pkgwarden.operators.rank_index import ROW, IndexedTable, write_indexed
from pkgwarden.plans.search import sort_keys
from test_refresh import write_feeds

COLUMNS = ("Package", "Version", "osv_id")


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    pick = lambda *values: draw.choice(values)
    found = [
        (f"p{draw.randrange(40):02}", pick(None, "1.0", "1.10", "", "é"), pick(None, "a", "b"),
         pick("SAFE", "FIXED"), draw.randrange(3))
        for _ in range(900)
    ]
    copies = [("p07", "1.0", None, "SAFE", 1)] * 300
    schema = "Package string, Version string, osv_id string, status string, n int"
    return spark.createDataFrame(found + copies, schema).repartition(5)


@pytest.fixture(scope="module", params=[1, 4])
def indexed(spark, rows, tmp_path_factory, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == 1))
    path = str(tmp_path_factory.mktemp("indexed") / "t")
    write_indexed(rows, path, total_order(rows, sort_keys()), COLUMNS, "status")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return IndexedTable(spark, path, COLUMNS, spark.read.parquet(f"{path}/rows").schema)


@pytest.mark.parametrize("column", [None, *COLUMNS])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_are_those_of_the_sorted_frame(rows, indexed, monkeypatch, column, descending):
    monkeypatch.setattr(rank_index, "NAMED_ROWS", 300)
    keys = sort_keys(column, "desc" if descending else "asc")
    expected = [tuple(r) for r in ordered(rows, total_order(rows, keys)).collect()]
    for offset, limit in [(0, 10), (599, 40), (1150, 100), (1200, 5), (7, 0), (100, 700)]:
        page = indexed.page(column, descending and column is not None, limit, offset)
        found = [tuple(r) for r in page.select(*rows.columns).collect()]
        assert found == expected[offset : offset + limit]
    with pytest.raises(ValueError, match="negative"):
        indexed.page(None, False, -1, 0)


def test_the_index_is_written_in_ranges(indexed):
    ranges = indexed.spark.read.parquet(f"{indexed.path}/ranges").collect()
    assert {r["ordering"] for r in ranges} == {-1, 0, 1, 2, 3, 4, 5}
    for number in range(-1, 6):
        own = sorted((r["before"], r["rows"]) for r in ranges if r["ordering"] == number)
        assert [b for b, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == 1200


def jobs_of(spark, name, action) -> int:
    spark.sparkContext.setJobGroup(name, name)
    action()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_depth_does_not_change_the_number_of_jobs(spark, indexed):
    jobs = [
        jobs_of(spark, f"page-{indexed.path}-{offset}", indexed.page("Version", True, 20, offset).collect)
        + jobs_of(spark, f"look-{indexed.path}-{offset}", lambda o=offset: indexed.page("Version", True, 20, o))
        for offset in (0, 300, 1100)
    ]
    assert len(set(jobs)) == 1


def test_pages_of_a_published_version(spark, tmp_path):
    store = PackageStore(spark, str(tmp_path / "store"))
    version = store.refresh(write_feeds(tmp_path / "feeds"), "first")
    report = version.package_safety_report()
    for column, order in [(None, None), ("version", "desc"), ("license", "asc"), ("nothing", "desc"),
                          ("osv_safety_status", "asc")]:
        key = sort_keys(column, order)[0]
        key = key if key.column in report.columns else SortKey("Package", key.descending)
        keys = [key, *[k for k in sort_keys() if k.column != key.column]]
        expected = ordered(report, total_order(report, keys)).collect()
        for offset in range(6):
            page = version.report_page(column, order, limit=2, offset=offset)
            assert page.rows.collect() == expected[offset : offset + 2]
            assert (page.total, page.limit, page.offset) == (5, 2, offset)
    assert ROW not in version.report_page().rows.columns
    search = version.search_packages(sort_by="version", sort_order="desc")
    assert [r["Version"] for r in search.rows.collect()] == ["1.10", "0.9"]
    assert version.search_packages(term="quoted").rows.columns == search.rows.columns
    assert ROW not in version.search_packages(format="ndjson").columns
    assert ROW not in spark.createDataFrame(
        version.search_packages(status="safe", format="ndjson").collect(), search.rows.schema
    ).columns
