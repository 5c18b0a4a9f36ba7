"""Pages against a sort in plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from pkgwarden.operators import SortKey, page, paged, paging
from pkgwarden.streaming import json_rows, stream_ndjson, write_ndjson

COLUMNS = ["name", "n", "note"]


def make_rows(seed: int = 5):
    """A third of the rows are copies of one row; values repeat and some are null."""
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["a", "b", "B", "é", None, "zz", "c'd"]),
            rng.choice([None, *range(40)]),
            rng.choice(["x", "y", None]),
        )
        for _ in range(400)
    ] + [("b", 7, "x")] * 200
    rng.shuffle(rows)
    return rows


def brute_force(rows, keys):
    order = [*keys, *[(c, False) for c in COLUMNS if c not in {k for k, _ in keys}]]

    def compare(left, right):
        for column, descending in order:
            x, y = left[COLUMNS.index(column)], right[COLUMNS.index(column)]
            if x == y:
                continue
            if x is None or y is None:
                return 1 if x is None else -1
            if isinstance(x, str):
                x, y = x.encode(), y.encode()
            return (1 if x > y else -1) * (-1 if descending else 1)
        return 0

    return sorted(rows, key=cmp_to_key(compare))


@pytest.fixture(scope="module")
def data(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "name string, n int, note string").repartition(3).cache()
    return rows, df


ORDERS = [
    [("name", False)],
    [("name", True), ("n", False)],
    [("n", True)],
    [("note", False), ("n", True), ("name", True)],
]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("offset", [0, 3, 250, 399, 590, 600, 1000])
def test_deep_page(data, order, offset):
    rows, df = data
    keys = [SortKey(c, d) for c, d in order]
    found = [tuple(r) for r in page(df, keys, 25, offset, top_k_rows=10).collect()]
    assert found == brute_force(rows, order)[offset : offset + 25]


@pytest.mark.parametrize(("limit", "offset"), [(7, 0), (300, 0), (320, 150), (600, 0), (1000, 5)])
def test_page_of_a_large_result(data, limit, offset):
    """Any page of a very large result is looked up, a shallow or a long one too."""
    rows, df = data
    order = [("name", True), ("n", False)]
    keys = [SortKey(c, d) for c, d in order]
    found = page(df, keys, limit, offset, len(rows), top_k_rows=20, handed_rows=0).collect()
    assert [tuple(r) for r in found] == brute_force(rows, order)[offset : offset + limit]


def test_deep_page_with_a_sample_that_runs_out(data, monkeypatch):
    """A small sample has to be drawn again inside the gap; the page stays the same."""
    rows, df = data
    monkeypatch.setattr(paging, "SAMPLED_ROWS", 12)
    monkeypatch.setattr(paging, "SPLITTERS", 3)
    order = [("n", False), ("name", True), ("note", False)]
    found = page(df, [SortKey(c, d) for c, d in order], 40, 333, top_k_rows=4).collect()
    assert [tuple(r) for r in found] == brute_force(rows, order)[333:373]


@pytest.mark.parametrize("top_k_rows", [20, 10_000])
def test_pages_together_are_the_whole_result(data, top_k_rows):
    rows, df = data
    keys = [SortKey("name", True)]
    found = []
    for offset in range(0, 601, 150):
        found += [tuple(r) for r in page(df, keys, 150, offset, None, top_k_rows).collect()]
    assert found == brute_force(rows, [("name", True)])


def test_deep_page_inside_many_copies(spark):
    df = spark.range(50).select(F.lit("k").alias("name"), F.lit(1).alias("n")).unionByName(
        spark.createDataFrame([("a", 0), ("z", 2), ("z", 3)], "name string, n int")
    )
    found = page(df, [SortKey("name")], 5, 48, top_k_rows=2).collect()
    assert [tuple(r) for r in found] == [("k", 1)] * 3 + [("z", 2), ("z", 3)]


def test_deep_page_by_time_and_double(spark):
    df = spark.range(300).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00.123456' + make_dt_interval(0, id % 50)").alias(
            "ts"
        ),
        (F.col("id") / 7).alias("x"),
        F.expr("date'2024-01-01' + cast(id % 9 as int)").alias("d"),
        "id",
    )
    keys = [SortKey("ts", True), SortKey("d")]
    plain = page(df, keys, 20, 150, top_k_rows=1000).collect()
    assert page(df, keys, 20, 150, top_k_rows=15).collect() == plain


def test_page_edges(data):
    rows, df = data
    keys = [SortKey("name")]
    nothing = paged(df, keys, limit=0)
    assert nothing.rows.count() == 0
    assert nothing.total == len(rows)
    assert paged(df, keys, offset=10_000).rows.count() == 0
    assert paged(df, keys).rows.count() == 100
    with pytest.raises(ValueError, match="negative"):
        page(df, keys, limit=-1)


def test_page_near_the_start_is_a_top_k(data, plan_of):
    _, df = data
    assert "TakeOrderedAndProject(limit=15" in plan_of(page(df, [SortKey("n")], 10, 5))


def test_envelope(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    found = paged(df, [SortKey("k")], limit=5, offset=1)
    assert json.loads(found.to_json()) == {
        "data": [{"k": "b", "v": 2}],
        "paging": {"limit": 5, "offset": 1, "total": 2},
    }
    assert [tuple(r) for r in found.envelope().collect()] == [('{"k":"b","v":2}', 5, 1, 2)]


def test_ndjson_leaves_nulls_out_and_keeps_microseconds(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-01 00:00:00.123456' AS ts, NULL AS v")
    expected = '{"k":"a","ts":"2024-01-01T00:00:00.123456"}'
    assert [r["json"] for r in json_rows(df).collect()] == [expected]
    assert list(stream_ndjson(df)) == [expected]
    write_ndjson(df, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [expected]


def test_brute_force_sees_copies():
    assert Counter(make_rows())[("b", 7, "x")] >= 200
