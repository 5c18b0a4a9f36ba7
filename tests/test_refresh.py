"""Refresh job: staging, publication, history, run log, failure."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pkgwarden import Feeds, PackageStore
from pkgwarden.operators import (
    JoinLimits,
    KeyViolation,
    insert_if_absent,
    key_violations,
    pivot_keys,
    require_unique,
)
from pkgwarden.plans import records, refresh
from pkgwarden.plans.refresh import PublicationConflict
from pkgwarden.sources import files
from pkgwarden.sources.schemas import RELEASE_HISTORY

CATALOGUE = """Package;Version;Title;Description;Published;License;Date/Publication;Size
abc;1.10;"A ""quoted"" title";"one; two
lines";2024-01-02;MIT;2024-01-02;5
def;0.9;D;;2024-01-03;GPL;2024-01-03;6
"""
ARCHIVE = """file_name;size
abc/abc_1.2.tar.gz;10K
abc/abc.tar.gz;1K
xyz/xyz_3.0-1.tar.gz;7K
"""
ADVISORY = {
    "id": "OSV-1",
    "affected": [
        {
            "package": {"name": "abc", "ecosystem": "CRAN"},
            "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.9"}]}],
        }
    ],
}


def write_feeds(base, release="4.5.3", day="2026-03-11"):
    (base / "ALL").mkdir(parents=True, exist_ok=True)
    (base / "packages.csv").write_text(CATALOGUE)
    (base / "archive.csv").write_text(ARCHIVE)
    (base / "ALL" / "a.json").write_text(json.dumps(ADVISORY, indent=2))
    values = {"Release": release, "Nickname": "Nick", "Date": day, "Devel": "4.7.0", "Other": "x"}
    (base / "VERSION-INFO.json").write_text(
        json.dumps([{"key": k, "value": f" {v}"} for k, v in values.items()], indent=1)
    )
    return Feeds(str(base))


@pytest.fixture
def store(spark, tmp_path):
    return PackageStore(spark, str(tmp_path / "store"))


def test_nothing_published_yet(store):
    assert store.manifest() is None
    with pytest.raises(LookupError):
        store.current()
    assert store.log_count() == 0


def test_refresh_twice(spark, store, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    first = store.refresh(source, "first")
    assert first.run_id == 1
    report = {
        (r["Package"], r["Version"], r["status"]): r["osv_safety_status"]
        for r in first.package_safety_report().collect()
    }
    assert report == {
        ("abc", "1.10", "current"): "FIXED",
        ("def", "0.9", "current"): "SAFE",
        ("abc", "1.2", "archived"): "VULNERABLE",
        ("abc", "", "archived"): "FIXED",
        ("xyz", "3.0-1", "archived"): "SAFE",
    }
    page = json.loads(first.search_packages(term="one; two\nlines").to_json())
    assert page["paging"] == {"limit": 100, "offset": 0, "total": 1}
    assert page["data"][0]["Title"] == 'A "quoted" title'
    assert first.search_packages(status="fixed").total == 1

    second = store.refresh(source, "second")
    assert second.run_id == 2
    assert second.release_history().total == 1
    runs = second.refresh_log().rows.collect()
    assert [r["run_id"] for r in runs] == [2, 1]
    assert {r["status"] for r in runs} == {"SUCCESS"}
    assert runs[0]["osv_source_pattern"].endswith("feeds/ALL/*.json")
    assert all(r["refresh_timestamp"] for r in runs)
    assert store.log_count() == 2
    assert [r["msg"] for r in store.logs().rows.collect()] == ["first", "second"]

    third = store.refresh(write_feeds(tmp_path / "feeds", "4.6.0", "2026-04-24"), "third")
    history = third.release_history().rows.collect()
    assert [r["r_version"] for r in history] == ["4.6.0", "4.5.3"]
    assert str(history[0]["release_date"]) == "2026-04-24"
    assert all(r["detected_at"] for r in history)
    # A reader that holds an earlier version goes on reading it.
    assert first.release_history().total == 1
    assert first.package_safety_report().count() == 5


def test_failed_refresh_leaves_the_version_before(store, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    store.refresh(source, "first")
    write_feeds(tmp_path / "feeds", day="some day")
    with pytest.raises(Exception, match="not a date"):
        store.refresh(source, "bad date")
    (tmp_path / "feeds" / "ALL" / "b.json").write_text("{broken")
    write_feeds(tmp_path / "feeds")
    with pytest.raises(Exception, match="(?i)malformed"):
        store.refresh(source, "bad document")
    assert store.current().run_id == 1
    assert store.log_count() == 1
    assert store.current().search_packages().total == 2


def test_null_release_is_refused(store, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    (tmp_path / "feeds" / "VERSION-INFO.json").write_text('[{"key": "Nickname", "value": "n"}]')
    with pytest.raises(KeyViolation):
        store.refresh(source, "no release")
    assert store.manifest() is None


def test_status_filter_reads_only_its_files(store, tmp_path, plan_of):
    version = store.refresh(write_feeds(tmp_path / "feeds"), "first")
    plan = plan_of(version.search_packages(status="safe", format="ndjson"))
    assert "PartitionFilters: [isnotnull(osv_safety_status" in plan


def test_views(spark, store, tmp_path):
    version = store.refresh(write_feeds(tmp_path / "feeds"), "first")
    version.register_views()
    counts = {
        name: spark.table(name).count()
        for name in (
            "stage_cran_current",
            "stage_cran_archive",
            "osv_flat",
            "vulnerability_lookup",
            "stage_r_info",
            "r_release_history",
            "data_refresh_log",
            "packages_search",
            "package_safety_report",
            "logs",
        )
    }
    assert counts["package_safety_report"] == 5
    assert counts.pop("logs") == 1
    assert counts == {r["table_name"]: r["n_rows"] for r in version.row_counts().collect()}
    assert spark.table("stage_cran_archive").columns == ["file_name", "size"]
    assert spark.table("vulnerability_lookup").columns == [
        "Package",
        "osv_id",
        "introduced_v",
        "fixed_v",
    ]
    late = spark.sql("SELECT Package FROM packages_search WHERE r_ver(Version) >= r_ver('1.9')")
    assert [r[0] for r in late.collect()] == ["abc"]


@pytest.mark.parametrize("when", ["before the record is created", "after it", "while staging"])
@pytest.mark.parametrize("published", [0, 1])
def test_of_two_refreshes_from_one_version_one_raises(store, tmp_path, monkeypatch, when, published):
    """A second refresh runs completely at some step of the first."""
    source = write_feeds(tmp_path / "feeds")
    for i in range(published):
        store.refresh(source, f"early {i}")
    other = PackageStore(store.spark, store.root)
    create, winners, losers = files.create_once, [], []

    def second():
        try:
            winners.append(other.refresh(source, "second"))
        except PublicationConflict as conflict:
            losers.append(conflict)

    def hooked(spark, path, text):
        if "/runs/records/" not in path or hooked.used:
            return create(spark, path, text)
        hooked.used = True
        if when == "after it":
            won = create(spark, path, text)
            second()
            return won
        second()
        return create(spark, path, text)

    hooked.used = when == "while staging"
    monkeypatch.setattr(files, "create_once", hooked)
    if when == "while staging":
        counts = refresh._row_counts

        def staged(frames):
            if not winners:
                monkeypatch.setattr(refresh, "_row_counts", counts)
                second()
            return counts(frames)

        monkeypatch.setattr(refresh, "_row_counts", staged)
    if when == "after it":
        # The first has won its number; the second began later and takes the next.
        winners.append(store.refresh(source, "first"))
        messages = ["second", "first"]
    else:
        with pytest.raises(PublicationConflict):
            store.refresh(source, "first")
        messages = ["second"]
    assert losers == []
    runs = store.current().refresh_log().rows.collect()
    assert sorted(r["run_id"] for r in runs) == list(range(1, published + len(winners) + 1))
    assert store.current().entry["version"] in {w.entry["version"] for w in winners}
    logged = [r["msg"] for r in store.log_table().orderBy("ts").collect()]
    assert logged == [f"early {i}" for i in range(published)] + messages
    for winner in winners:
        assert winner.package_safety_report().count() == 5


def test_refreshes_at_the_same_time(spark, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    root = str(tmp_path / "store")

    def attempt(name):
        try:
            return PackageStore(spark, root).refresh(source, name).run_id
        except PublicationConflict:
            return None

    with ThreadPoolExecutor(3) as pool:
        numbers = [n for n in pool.map(attempt, "abc") if n]
    assert sorted(numbers) == list(range(1, len(numbers) + 1)) and numbers
    store = PackageStore(spark, root)
    assert store.current().run_id == len(numbers) == store.log_count()


def test_history_and_run_log_are_shared(store, tmp_path):
    """A refresh writes its own rows only, whatever the length of the history."""
    for i in range(1, 5):
        version = store.refresh(write_feeds(tmp_path / "feeds", f"4.{i // 2}.0"), f"m{i}")
        folder = os.path.join(store.root, version.entry["version"])
        assert not {"r_release_history", "data_refresh_log"} & set(os.listdir(folder))
    assert [len(r["released"]) for r in store.commits.rows().orderBy("run_id").collect()] == [1, 1, 0, 1]
    assert version.release_history().total == 3 == version.entry["row_counts"]["r_release_history"]
    assert version.refresh_log().total == 4 == version.entry["row_counts"]["data_refresh_log"]
    sizes = [os.path.getsize(store.commits._record(n)) for n in range(1, 5)]
    assert max(sizes) - min(sizes) < 300


def test_many_messages_are_read_from_few_files(store):
    for i in range(70):
        store.log(f"message {i}")
    assert store.log_count() == 70
    assert len(store.log_table().inputFiles()) <= 2 + 70 % 32
    page = store.logs(limit=5, offset=64).rows.collect()
    assert [r["msg"] for r in page] == [f"message {i}" for i in range(64, 69)]


def test_reading_writes_nothing(store):
    assert store.manifest() is None
    assert store.log_count() == 0
    assert not os.path.exists(store.root)


def test_expire_keeps_the_current_version(store, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    for name in ("a", "b", "c"):
        last = store.refresh(source, name)
    assert len(store.expire(keep=1)) == 2
    assert store.expire(keep=1) == []
    assert store.current().entry["version"] == last.entry["version"]
    assert store.current().package_safety_report().count() == 5
    with pytest.raises(ValueError, match="current"):
        store.expire(keep=0)


def test_status_of_the_report_in_any_case(store, tmp_path, plan_of):
    version = store.refresh(write_feeds(tmp_path / "feeds"), "first")
    whole = version.package_safety_report().count()
    assert version.package_safety_report("all").count() == whole
    assert version.package_safety_report("").count() == whole
    for status in ("safe", "FIXED", "Vulnerable"):
        expected = version.package_safety_report().filter(
            F.col("osv_safety_status") == status.upper()
        )
        assert version.package_safety_report(status).count() == expected.count()
    assert "PartitionFilters: [isnotnull" in plan_of(version.package_safety_report("fixed"))


def test_large_lookup_gives_the_same_version(spark, tmp_path):
    source = write_feeds(tmp_path / "feeds")
    plain = PackageStore(spark, str(tmp_path / "plain")).refresh(source, "m")
    limits = JoinLimits(broadcast_rows=0, cell_rows=1)
    large = PackageStore(spark, str(tmp_path / "large"), limits).refresh(source, "m")
    for name in ("packages_search", "package_safety_report"):
        left, right = (getattr(v, name)().collect() for v in (plain, large))
        assert sorted(map(str, left)) == sorted(map(str, right))


def test_second_insert_adds_nothing(spark):
    history = spark.createDataFrame([], RELEASE_HISTORY)
    info = spark.sql(
        "SELECT 'v1' AS r_version, 'n' AS nickname, date'2024-01-01' AS release_date,"
        " 'd' AS devel_version"
    )
    once = records.record_release(info, history)
    assert once.count() == 1
    assert records.record_release(info, once).count() == 1
    stamp = {"detected_at": F.lit(None).cast("timestamp_ntz")}
    assert insert_if_absent(info, once, "r_version", stamp).count() == 0


def test_pivot_of_no_records_is_one_null_row(spark):
    empty = spark.createDataFrame([], "key string, value string")
    assert [tuple(r) for r in pivot_keys(empty, {"a": "x", "b": "y"}).collect()] == [(None, None)]
    assert pivot_keys(empty, {"a": "x"}, group_by=["key"]).count() == 0


def test_key_violations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2)], "k string, n int")
    found = {tuple(r) for r in key_violations(df, ["k"]).collect()}
    assert found == {("a", 2), (None, 1)}
    require_unique(df.filter("k = 'b'"), ["k"], "t")
    with pytest.raises(KeyViolation):
        require_unique(df, ["k"], "t")
