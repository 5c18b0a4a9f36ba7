"""Keys of versions of any length, from SQL and as a Column; a literal's key is computed once."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pkgwarden.functions import register_version_function, version_at_least, version_key


def test_the_function_gives_the_key_of_any_version(spark):
    draw = random.Random(5)
    segments = ["0", "7", "10", "2147483647", "2147483648", "a", "", " 5 ", "+4", "1e3", "007"]
    versions = {"", "-", "..", None, "1.2.3.4", "1.2.3.4.5"}
    for _ in range(400):
        found = [draw.choice(segments) for _ in range(draw.randrange(1, 9))]
        versions.add("".join(s + draw.choice(".-") for s in found)[:-1])
    register_version_function(spark)
    spark.createDataFrame([(v,) for v in versions], "v string").createOrReplaceTempView("drawn_versions")
    found = spark.sql("SELECT v, r_ver(v) AS k FROM drawn_versions")
    assert found.filter(~F.col("k").eqNullSafe(version_key(F.col("v")))).count() == 0
    assert found.filter("v IS NULL AND k IS NULL").count() == 1


def test_the_key_of_a_literal_is_not_computed_for_every_row(spark, plan_of):
    register_version_function(spark)
    spark.range(5).select(F.col("id").cast("string").alias("v")).createOrReplaceTempView("some_versions")
    late = spark.sql("SELECT count_if(r_ver(v) >= r_ver('3-0')) AS n FROM some_versions")
    # Only the column's key is left in the plan, once in each place that uses it.
    assert "0x0000000300000000" in plan_of(late)
    assert plan_of(spark.sql("SELECT r_ver('3-0.x') AS k, v FROM some_versions")).count("unhex") == 0
    assert late.first()["n"] == 1


def test_keys_of_versions_of_any_length(spark):
    def number(segment: str) -> int:
        known = re.fullmatch(r"\+?\d+", segment.strip())
        return int(segment) if known and int(segment) < 2**31 else 2**31

    versions = ["7", "", "1.2.3.4", "1.2.3.4.5", "1-2.x-4-2147483648.6..7", " 5 .+4-007.a.b.c", "....", "1.2.3.4.-"]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").select("v", version_key(F.col("v")).alias("k"))
    for row in rows.collect():
        segments = re.split("[.-]", row["v"])
        assert bytes(row["k"]) == b"".join(number(s).to_bytes(4, "big") for s in segments), row["v"]


def test_a_literal_is_compared_by_its_key(spark, plan_of):
    rows = spark.range(5).select(F.col("id").cast("string").alias("v"))
    late = rows.select(version_at_least(F.col("v"), F.lit("3-0")).alias("late"))
    assert "0x0000000300000000" in plan_of(late)
    assert [r["late"] for r in late.collect()] == [False, False, False, False, True]


def test_two_segments_are_written_as_one_number(spark, plan_of):
    rows = spark.range(5).select(F.col("id").cast("string").alias("v"))
    # Two pairs, and the segments beyond them.
    assert plan_of(rows.select(version_key(F.col("v")).alias("k"))).count("lpad(hex(") == 3
    odd = [None, "", "1", "1-2", "1.2.3", "x.1.2147483648", "2147483647.x.2147483647.x", "a.1.2.3.4"]
    found = spark.createDataFrame([(v,) for v in odd], "v string").select(version_key(F.col("v")).alias("k"))
    sizes = [None if row["k"] is None else len(row["k"]) for row in found.collect()]
    assert sizes == [None, 4, 4, 8, 12, 12, 16, 20]
