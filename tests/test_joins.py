"""The lookup join beyond the broadcast limit, and NOT IN."""

from __future__ import annotations

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pkgwarden.operators import joins
from pkgwarden.operators import (
    JoinLimits,
    Size,
    lookup_join,
    measure,
    rows_absent,
    spread_stored,
)

TIGHT = JoinLimits(broadcast_rows=0, cell_rows=5, cell_pairs=100)


def frames(spark):
    """Both sides hold a hot key with copies of one row; each side has null and lone keys."""
    rows = [("hot", i % 3) for i in range(300)] + [("warm", i) for i in range(6)]
    rows += [("lone", 1), (None, 2), (None, 3)]
    lookup = [("hot", 7)] * 150 + [("hot", i) for i in range(20)] + [("warm", 1), ("warm", None)]
    lookup += [("other", 5), (None, 9)]
    return (
        spark.createDataFrame(rows, "k string, a int"),
        spark.createDataFrame(lookup, "k string, b int"),
    )


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_cells_give_the_plain_join(spark, how):
    rows, lookup = frames(spark)
    expected = multiset(rows.join(lookup, "k", how).select("k", "a", "b"))
    assert multiset(lookup_join(rows, lookup, "k", how, limits=TIGHT)) == expected
    assert multiset(lookup_join(rows, lookup, "k", how)) == expected


def test_small_lookup_is_broadcast_and_rows_are_not_shuffled(spark, plan_of):
    rows, lookup = frames(spark)
    plan = plan_of(lookup_join(rows, lookup, "k"))
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan


def test_large_lookup_is_shuffled_and_its_hot_key_is_spread(spark, plan_of):
    rows, lookup = frames(spark)
    stored = spread_stored(lookup)
    joined = lookup_join(rows, stored, "k", limits=TIGHT)
    plan = plan_of(joined)
    assert "SortMergeJoin [k#" in plan and "_cell#" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    hot = stored.filter("k = 'hot'").count()
    cells = -(-hot // TIGHT.cell_rows)
    largest = (
        stored.filter("k = 'hot'").groupBy((F.col("spread") % cells).alias("c")).count()
    ).agg(F.max("count")).first()[0]
    assert largest < hot / 3


def test_keys_hot_by_rows_times_entries_are_cut_on_both_sides(spark):
    """No task emits more than a bounded share of a hot key's output, whatever the hot list's size."""
    rows = spark.range(900).select(F.lit("hot").alias("k"), F.col("id").alias("a"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS k, 7L AS a"))
    lookup = spark.range(90).select(F.lit("hot").alias("k"), F.col("id").alias("b"))
    for hot_list in (1_000_000, 0):
        limits = JoinLimits(hot_list, cell_rows=100, cell_pairs=10_000)
        for how in ("left", "inner"):
            size = Size(10**9, 10**12)
            joined = lookup_join(rows, lookup, "k", how, size=size, limits=limits)
            assert multiset(joined) == multiset(rows.join(lookup, "k", how).select("k", "a", "b"))
            with_task = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count()
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                most = with_task.agg(F.max("count")).first()[0]
            finally:
                spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            assert most < 81_000


def test_hot_candidate_key_of_a_large_anti_join_is_split(spark, plan_of):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        rows = spark.range(0, 30_000, 1, 8).select(
            key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a")
        )
        known = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"))
        absent = rows_absent(rows, known, "k", limits=TIGHT)
        assert len(absent.collect()) == rows.join(known, "k", "left_anti").count()
        assert "skew=true" in plan_of(absent)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_measure(spark):
    df = spark.createDataFrame([("ab", [1, 2]), (None, None)], "s string, a array<bigint>")
    assert measure(df) == Size(2, 2 * 16 + 2 + 16)
    assert measure(df.limit(0)) == Size(0, 0)


@pytest.mark.parametrize(
    ("existing", "expected"),
    [
        ([], ["a", "b", None]),
        (["a"], ["b"]),
        (["a", None], []),
        ([None], []),
        (["z"], ["a", "b"]),
    ],
)
@pytest.mark.parametrize("limits", [JoinLimits(), TIGHT])
def test_rows_absent_is_not_in(spark, existing, expected, limits):
    candidates = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    known = spark.createDataFrame([(e,) for e in existing], "k string")
    found = [r["k"] for r in rows_absent(candidates, known, "k", limits=limits).collect()]
    candidates.createOrReplaceTempView("candidates")
    known.createOrReplaceTempView("known")
    by_sql = spark.sql("SELECT k FROM candidates WHERE k NOT IN (SELECT k FROM known)").collect()
    assert Counter(found) == Counter(expected) == Counter(r["k"] for r in by_sql)


def test_key_with_many_rows_is_split_at_run_time(spark, plan_of):
    """A third of all rows has one key: with thresholds for small data, its partition is split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        rows = spark.range(0, 30_000, 1, 8).select(
            key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a")
        )
        lookup = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), "id")
        lookup = lookup.unionByName(spark.range(20).select(F.lit("hot").alias("k"), "id"))
        limits = JoinLimits(broadcast_rows=0, cell_rows=1000)
        joined = lookup_join(rows, lookup, "k", limits=limits)
        assert len(joined.collect()) == rows.join(lookup, "k", "left").count()
        plan = plan_of(joined)
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_the_hot_join_takes_the_whole_lookup(spark):
    """left_join_whole against nested loops; every part whose key has events is in the result."""
    events = [(i, i % 7, kind) for i, kind in enumerate(["view", "signup", "error", "click"] * 15)]
    parts = [(i, 1 if i % 3 == 1 else 2) for i in range(50)]
    folder = tempfile.mkdtemp(prefix="run-")
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string")
    frame.write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(
        f"{folder}/part.parquet"
    )
    expected = Counter()
    for event, user, kind in events:
        k = {"view": 0, "signup": event, "error": user}.get(kind)
        found = [p for p, size in parts if k is not None and (1 if size == 1 else p) == k]
        expected.update((event, k, p) for p in found or [None])
    reached = {p for _, _, p in expected if p is not None}
    assert {p for p, size in parts if size == 1} <= reached
    assert multiset(entry.left_join_whole(spark, folder)) == expected


def test_frequent_keys_are_proposed_without_a_shuffle_of_the_rows(spark, monkeypatch, plan_of):
    monkeypatch.setattr(joins, "PROPOSED", 3)
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm")
    rows = spark.range(20_000).select(F.coalesce(hot, F.concat(F.lit("k"), "id")).alias("k"), "id")
    rows = rows.union(spark.range(500).selectExpr("CAST(NULL AS STRING)", "id"))
    found = joins.frequent_keys(rows, "k")
    assert {"hot", "warm"} <= {r["k"] for r in found.collect()} and found.count() == 3
    assert "hashpartitioning(k" not in plan_of(found)
    assert joins.frequent_keys(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "date", "binary", "decimal(5,1)"])
def test_hot_keys_of_all_types(spark, kind):
    limits = JoinLimits(broadcast_rows=0, cell_rows=4, cell_pairs=50)
    text = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 30)
    day = F.date_add(F.lit("2024-01-01").cast("date"), text.cast("int"))
    key = {"date": day, "binary": text.cast("string").cast("binary")}.get(kind, text.cast("string").cast(kind))
    rows = spark.range(60).select(key.alias("k"), F.col("id").alias("a"))
    lookup = spark.range(40).select(key.alias("k"), F.col("id").alias("b"))
    expected = rows.join(lookup, "k", "left")
    found = lookup_join(rows, lookup, "k", limits=limits)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
