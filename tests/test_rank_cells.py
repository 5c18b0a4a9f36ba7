"""The rank index holds a row for each value and block, not for each row of the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pkgwarden.operators import ordered, total_order
from pkgwarden.operators import rank_index
from pkgwarden.operators.rank_index import IndexedTable, write_indexed
from pkgwarden.plans.search import sort_keys

COLUMNS = ("Package", "Version", "osv_id")


def frame(spark, n):
    """Many rows of few values; the partition column looks like a number."""
    i = F.col("id")
    return spark.range(0, n, numPartitions=4).select(
        F.concat(F.lit("p"), i % 9).alias("Package"),
        F.when(i % 5 > 0, F.concat(i % 3, F.lit(".1"))).alias("Version"),
        F.when(i % 11 == 0, F.lit("")).otherwise(F.lit("OSV")).alias("osv_id"),
        F.concat(F.lit("0"), i % 2).alias("status"),
        (i % 40).alias("n"),
    )


def written(spark, rows, path, columns=COLUMNS):
    write_indexed(rows, path, total_order(rows, sort_keys()), columns, "status")
    names = ["Package", "Version", "osv_id", "n", rank_index.ROW, "status"]
    schema = rows.withColumn(rank_index.ROW, F.lit(1).cast("bigint")).select(*names).schema
    return IndexedTable(spark, path, columns, schema)


def stored_rows(spark, path) -> int:
    """Rows of all tables of an index."""
    names = ("cells", "places", "ranges")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))
    return sum(spark.read.parquet(f"{path}/{n}").count() for n in names if exists(f"{path}/{n}"))


def test_the_index_does_not_grow_with_rows_of_known_values(spark, tmp_path):
    sizes = []
    for n in (2_000, 20_000):
        path = str(tmp_path / f"t{n}")
        written(spark, frame(spark, n), path)
        sizes.append(stored_rows(spark, path))
    assert sizes[1] <= 2 * sizes[0] and sizes[1] < 2_000


@pytest.mark.parametrize("named", [2_000, 20])
def test_pages_cut_blocks_and_values(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(rank_index, "BLOCK_BITS", 4)
    monkeypatch.setattr(rank_index, "NAMED_ROWS", named)
    rows = frame(spark, 1_000)
    columns = (*COLUMNS, "status")
    table = written(spark, rows, str(tmp_path / "t"), columns)
    for column in columns:
        for descending in (False, True):
            keys = sort_keys(column, "desc" if descending else "asc")
            if column == "status":
                keys[0] = type(keys[0])("status", descending)
            expected = [tuple(r) for r in ordered(rows, total_order(rows, keys)).collect()]
            for offset, limit in [(0, 7), (333, 30), (795, 60), (990, 50)]:
                page = table.page(column, descending, limit, offset).select(*rows.columns)
                assert [tuple(r) for r in page.collect()] == expected[offset : offset + limit]
