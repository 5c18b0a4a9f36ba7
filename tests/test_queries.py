"""Every registered query against its SQL check, on whole tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from compare import as_multiset, oracle, oracle_result, sf_dir, spark_result

import __spark_entry__ as entry

KINDS = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


@pytest.fixture(scope="module")
def checks():
    connection = oracle(sf_dir())
    yield connection
    connection.close()


def test_every_query_has_a_check():
    assert set(entry.core_queries()) == set(entry.core_oracle_sql())
    assert set(entry.queries()) >= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.core_queries()))
def test_query(spark, checks, name):
    df = entry.queries()[name](spark, sf_dir())
    sql = entry.oracle_sql()[name]
    assert spark_result(df) == oracle_result(checks, sql)
    relation = checks.sql(sql)
    expected = sorted(
        (column, KINDS.get(str(kind), str(kind)))
        for column, kind in zip(relation.columns, relation.types, strict=True)
    )
    found = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    assert found == expected


@pytest.mark.parametrize(
    ("name", "column", "descending"),
    [("sort_asc", "osv_id", False), ("sort_desc", "Published", True)],
)
def test_sorted_results_come_in_order_with_nulls_last(spark, name, column, descending):
    values = [row[column] for row in entry.queries()[name](spark, sf_dir()).collect()]
    present = [v for v in values if v is not None]
    assert values == sorted(present, reverse=descending) + [None] * (len(values) - len(present))


def test_flagship_counts(spark):
    """Counts known beforehand for the smallest tables."""
    report = entry.safety_report(spark, "/root/testdata/sf0.001")
    found = {
        (r["status"], r["osv_safety_status"]): r["count"]
        for r in report.groupBy("status", "osv_safety_status").count().collect()
    }
    assert found == {
        ("current", "SAFE"): 153,
        ("current", "FIXED"): 7,
        ("current", "VULNERABLE"): 40,
        ("archived", "SAFE"): 4687,
        ("archived", "FIXED"): 127,
        ("archived", "VULNERABLE"): 1186,
    }


def test_import_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)


def test_multiset_notices_duplicates():
    assert as_multiset(["a"], [(1,), (1,)]) != as_multiset(["a"], [(1,)])
