"""Version order, safety status, archive names, search patterns and strict dates."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pkgwarden.functions import (
    archive_package,
    archive_version,
    contains_any,
    register_version_function,
    safety_status,
    strict_date,
    version_at_least,
    version_key,
    version_literal,
)

VERSION_PAIRS = [
    ("1.10", "1.9", True),
    ("1.2", "1.2.0", False),
    ("1.2.0", "1.2", True),
    ("1.0-1", "1.0", True),
    ("1.a", "1.2", True),
    ("1.2", "1.a", False),
    ("1.a", "1.b", True),
    ("", "9.9", True),
    (None, "1", None),
    ("1.2.", "1.2", True),
    ("007", "7", True),
    ("2147483648", "5", True),
    (" 2 ", "2", True),
]


def test_version_pairs(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in VERSION_PAIRS], "a string, b string")
    found = df.select("a", "b", version_at_least(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == VERSION_PAIRS


def test_version_function_in_sql(spark):
    register_version_function(spark)
    df = spark.createDataFrame([(a, b) for a, b, _ in VERSION_PAIRS], "a string, b string")
    df.createOrReplaceTempView("version_pairs")
    found = spark.sql("SELECT a, b, r_ver(a) >= r_ver(b) FROM version_pairs").collect()
    assert [tuple(r) for r in found] == VERSION_PAIRS


def test_random_versions_compare_like_native_lists(spark):
    rng = random.Random(7)
    segments = ["0", "1", "2", "10", "09", "a", "", "2147483647", "2147483648", "99999999999", "-"]
    texts = [
        rng.choice([".", "-"]).join(rng.choices(segments, k=rng.randint(1, 4))) for _ in range(400)
    ]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = [
        tuple(r) for r in df.select("a", "b", version_at_least(F.col("a"), F.col("b"))).collect()
    ]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pairs (n INTEGER, a VARCHAR, b VARCHAR)")
    connection.executemany(
        "INSERT INTO pairs VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)]
    )
    key = "list_transform(str_split_regex({}, '[.-]'), lambda s: TRY_CAST(s AS INTEGER))"
    expected = connection.sql(
        f"SELECT a, b, {key.format('a')} >= {key.format('b')} FROM pairs ORDER BY n"
    ).fetchall()
    assert found == expected


STATUSES = [
    (None, None, None, "1", "SAFE"),
    ("X", "0", "2.0", "2.0", "FIXED"),
    ("X", "0", "2.0", "1.9", "VULNERABLE"),
    ("X", "1.5", "2.0", "1.4", "SAFE"),
    ("X", None, "2.0", "1.0", "SAFE"),
    ("X", "0", None, "9", "VULNERABLE"),
    ("X", "0", "2.0", None, "SAFE"),
    ("X", "3.0", "2.0", "2.5", "FIXED"),
    ("X", "0", "2.0", "", "FIXED"),
    ("X", "0", None, "", "VULNERABLE"),
    ("X", None, None, "1", "SAFE"),
    (None, "0", "2.0", "1", "SAFE"),
]


def test_safety_status(spark):
    df = spark.createDataFrame(
        [row[:4] for row in STATUSES],
        "osv_id string, introduced string, fixed string, version string",
    )
    found = df.select(
        "*",
        safety_status(
            F.col("osv_id"),
            version_key(F.col("version")),
            version_key(F.col("introduced")),
            version_key(F.col("fixed")),
        ),
    )
    assert [tuple(r) for r in found.collect()] == STATUSES


ARCHIVE_NAMES = [
    ("ab/ab_1.0.tar.gz", "ab", "1.0"),
    ("ab/ab_1.0-2.tar.gz", "ab", "1.0-2"),
    ("ab/x_y_1.tar.gz", "ab", "1"),
    ("ab_1.0.tar.gz", "ab_1.0.tar.gz", "1.0"),
    ("ab/ab.tar.gz", "ab", ""),
    ("/ab_1.tar.gz", "", "1"),
    ("ab/ab_1.0.zip", "ab", ""),
    ("ab/ab_1.0.tar.gz\n", "ab", ""),
    ("", "", ""),
    (None, None, None),
]


def test_archive_names(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in ARCHIVE_NAMES], "name string")
    name = F.col("name")
    found = df.select("name", archive_package(name), archive_version(name)).collect()
    assert [tuple(r) for r in found] == ARCHIVE_NAMES


def test_random_archive_names_parse_like_the_patterns(spark):
    rng = random.Random(3)
    pieces = ["ab", "/", "_", "1.0", "-2", ".tar.gz", "x", "\n", ".", "é"]
    names = ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    name = F.col("name")
    found = [
        tuple(r) for r in df.select("name", archive_package(name), archive_version(name)).collect()
    ]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE names (n INTEGER, name VARCHAR)")
    connection.executemany("INSERT INTO names VALUES (?, ?)", list(enumerate(names)))
    expected = connection.sql(
        "SELECT name, regexp_extract(name, '^([^/]+)', 1),"
        r" regexp_extract(name, '_([0-9.-]+)\.tar\.gz$', 1) FROM names ORDER BY n"
    ).fetchall()
    assert found == expected


@pytest.mark.parametrize(
    ("term", "expected"),
    [
        ("\\b", ["a\\b"]),
        ("a\\", ["a\\b"]),
        ("a\\%b", ["a\\b"]),
        ("%", ["a\\b", "a%b", "x", "ÉT"]),
        ("", ["a\\b", "a%b", "x", "ÉT"]),
        ("A_B", ["a\\b", "a%b"]),
        ("ét", ["ÉT"]),
        ("X", ["x"]),
    ],
)
def test_search_terms(spark, term, expected):
    rows = [("a\\b", None), ("a%b", None), ("x", None), (None, "ÉT"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    found = [r["a"] or r["b"] for r in df.filter(contains_any(["a", "b"], term)).collect()]
    assert found == expected


def test_search_term_must_not_hold_the_escape_character():
    with pytest.raises(ValueError, match="U\\+0001"):
        contains_any(["a"], "x\u0001")


def test_strict_date(spark):
    df = spark.createDataFrame([("2024-02-29",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(strict_date(F.col("t"))).collect()] == [
        "2024-02-29",
        "None",
    ]


@pytest.mark.parametrize("text", ["2024", "2024-02-30", "soon", ""])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_date_raises(spark, text, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(text,)], "t string")
        with pytest.raises(Exception, match="not a date"):
            df.select(strict_date(F.col("t"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_stored_keys_are_filtered_at_the_scan(spark, tmp_path, plan_of):
    """Keys are written as they are compared, so whole files of smaller ones are skipped."""
    versions = [f"{a}.{b}" for a in range(30) for b in range(30)]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    keyed = df.withColumn("version_key", version_key(F.col("v")))
    path = str(tmp_path / "keys")
    keyed.repartitionByRange(6, "version_key").sortWithinPartitions("version_key").write.parquet(path)
    stored = spark.read.parquet(path)
    late = stored.filter(F.col("version_key") >= version_literal(spark, "25.3"))
    assert "PushedFilters: [IsNotNull(version_key), GreaterThanOrEqual(version_key," in plan_of(late)
    expected = [v for v in versions if tuple(map(int, v.split("."))) >= (25, 3)]
    assert sorted(r["v"] for r in late.collect()) == sorted(expected)
    leaf = late._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert len(expected) <= leaf.metrics().apply("numOutputRows").value() <= 2 * 900 // 6
    assert stored.filter(F.col("version_key") >= version_literal(spark, None)).count() == 0
