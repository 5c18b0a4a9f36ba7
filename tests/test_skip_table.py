"""A search reads only the files that may hold its term, and finds the same rows."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from pkgwarden import PackageStore
from pkgwarden.functions import contains_any
from pkgwarden.operators.skip_table import SkipTable, runs_in, runs_of, write_skip_table
from pkgwarden.plans import refresh
from pkgwarden.sources.feeds import _size_in_bytes
from test_refresh import write_feeds


def test_runs():
    assert runs_of("abcab") == {"abc", "bca", "cab"} and runs_of("ab") == set() == runs_of("")
    texts = ["abcab", "", "ab", "xyz ring", "straße\n", "a\x00b𝄞c"]
    assert runs_in(texts) == set().union(*map(runs_of, texts)) and runs_in([]) == set()


def test_a_refresh_writes_the_runs_beside_the_index(spark, tmp_path, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def met(step):
        def run(stored, path, *more):
            if refresh.SEARCH in path:
                both.wait()
            step(stored, path, *more)

        return run

    monkeypatch.setattr(refresh, "write_skip_table", met(refresh.write_skip_table))
    monkeypatch.setattr(refresh, "write_index", met(refresh.write_index))
    version = PackageStore(spark, str(tmp_path / "store")).refresh(write_feeds(tmp_path / "feeds"), "first")
    assert version.search_packages(term="nothing like it", format="ndjson").count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Files of names that lie together, with a column of words that are everywhere."""
    draw = random.Random(1)
    words = ["Ring", "SPRING", "İstanbul", "straße", "100%", "a_b", None, ""]
    rows = [(f"pkg{i:04}", draw.choice(words), f"v{i % 7}") for i in range(600)]
    folder = tmp_path_factory.mktemp("skip")
    df = spark.createDataFrame(rows, "name string, word string, kind string")
    df.repartitionByRange(6, "name").write.parquet(f"{folder}/rows")
    table = spark.read.parquet(f"{folder}/rows")
    write_skip_table(table, f"{folder}/runs", ["name", "word"])
    return table, SkipTable(spark, f"{folder}/runs")


@pytest.mark.parametrize("term", ["ring", "KG012", "pkg0599", "pkg05", "İST", "i̇stanbul", "STRASSE", "straß", "nothing", "v3x"])
def test_skipped_files_hold_no_match(stored, term):
    table, skip = stored
    files = skip.files(term)
    matching = table.filter(contains_any(["name", "word"], term)).select(F.col("_metadata.file_path"))
    needed = {r[0] for r in matching.distinct().collect()}
    assert needed <= set(files)
    if term.startswith("pkg"):
        assert len(files) < 6
    if term == "nothing":
        assert files == []


@pytest.mark.parametrize("term", ["ab", "", None, "a_b", "100%", "%ring"])
def test_short_terms_and_wildcards_read_everything(stored, term):
    assert stored[1].files(term) is None


def test_published_search_reads_fewer_files(spark, tmp_path, monkeypatch):
    source = write_feeds(tmp_path / "feeds")
    lines = [f"pkg{i:04};1.{i};Title {i};;2024-01-02;MIT;2024-01-02;5" for i in range(400)]
    path = tmp_path / "feeds" / "packages.csv"
    path.write_text(path.read_text() + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    version = PackageStore(spark, str(tmp_path / "store")).refresh(source, "first")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = version.table("packages_search")
    for term in ("pkg0007", "title 39", "QUOTED", "two\nlines", "nothing at all", "vulnerable", "g_0"):
        found = version.search_packages(term=term, format="ndjson")
        rows = whole.filter(contains_any(["Package", "Title", "Description", "Published", "Version",
                                          "status", "osv_id", "osv_safety_status"], term))
        assert sorted(r["Version"] for r in found.collect()) == sorted(r["Version"] for r in rows.collect())
        assert version.search_packages(term=term).total == rows.count()
    named = version.search_packages(term="pkg0007", format="ndjson")
    assert 0 < len(named.inputFiles()) < len(whole.inputFiles())


def test_sizes_of_settings():
    assert [_size_in_bytes(t) for t in ("128m", "134217728b", "1g", "64KB", " 5 ", "2GiB")] == [
        128 << 20, 134217728, 1 << 30, 64 << 10, 5, 2 << 30,
    ]
