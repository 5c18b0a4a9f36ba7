"""Numbered logs: numbers are given once, reading stays cheap, nothing is lost while merging."""

from __future__ import annotations

import datetime
import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import types as T

from pkgwarden.sources import files
from pkgwarden.sources.numbered import NUMBER, NumberedLog
from pkgwarden.sources.schemas import LOGS, struct

NOTES = struct(msg=T.StringType())


@pytest.fixture
def log(spark, tmp_path):
    return NumberedLog(spark, str(tmp_path / "log"), NOTES, fan=3)


def found(log) -> dict[int, str]:
    rows = log.rows().collect()
    assert len({r[NUMBER] for r in rows}) == len(rows)
    return {r[NUMBER]: r.msg for r in rows}


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "name.txt")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create_once(spark, path, f"text {i}\n"), range(16)))
    assert sum(won) == 1
    assert files.read_text(spark, path) == f"text {won.index(True)}\n"
    assert os.listdir(tmp_path / "folder") == ["name.txt"]
    assert not files.create_once(spark, path, "late")
    assert files.delete(spark, path) and not files.exists(spark, path)


def test_renaming_does_not_replace(spark, tmp_path):
    """The way of stores that are not local."""
    path = str(tmp_path / "name.txt")
    assert files._renamed(spark, f"{tmp_path}/.a", path, "first é")
    assert not files._renamed(spark, f"{tmp_path}/.b", path, "second")
    assert files.read_text(spark, path) == "first é"
    assert files.names(spark, str(tmp_path)) == ["name.txt"]


def test_records_of_all_kinds(spark, tmp_path):
    schema = T.StructType(
        [
            *LOGS.fields,
            T.StructField("day", T.DateType()),
            T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
            T.StructField("rows", T.ArrayType(LOGS)),
        ]
    )
    log = NumberedLog(spark, str(tmp_path / "log"), schema, fan=2)
    stamp = datetime.datetime(2026, 1, 2, 3, 4, 5, 678901)
    record = {
        "ts": stamp, "msg": 'a "line"\nand é   \\', "day": stamp.date(), "counts": {"a b": 1 << 40},
        "rows": [{"ts": stamp.replace(microsecond=0), "msg": None}],
    }
    for _ in range(3):
        log.append(record)
    log.append({})
    rows = sorted(log.rows().collect(), key=lambda r: r[NUMBER])
    for row in rows[:3]:
        assert row.asDict(recursive=True) == {NUMBER: row[NUMBER], **record}
    assert rows[3].asDict() == {NUMBER: 4, **dict.fromkeys(schema.names)}


def test_reading_an_empty_log_writes_nothing(log):
    assert (log.last(), log.newest(), log.rows().count()) == (0, None, 0)
    assert not os.path.exists(log.path)


def test_numbers_are_given_once(log):
    assert log.add(1, {"msg": "a"})
    assert not log.add(1, {"msg": "b"})
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: log.append({"msg": str(i)}), range(20)))
    assert sorted(numbers) == list(range(2, 22))
    assert found(log) == {1: "a", **{n: str(i) for i, n in enumerate(numbers)}}
    assert log.newest().msg == found(log)[21]


def test_long_logs_are_read_from_few_files(log):
    written = {}
    for n in range(1, 41):
        assert log.append({"msg": f"m{n}"}) == n
        written[n] = f"m{n}"
        if n % 7 == 0 or n % 9 == 0:
            assert found(log) == written and log.newest()[NUMBER] == n
    assert found(log) == written
    assert len(log.rows().inputFiles()) <= 2 * 3 * 4
    # What merging has replaced is deleted, but for the latest.
    assert len(log._loose()) <= 6
    # A writer that comes much too late wins no number that has been given.
    for n in (1, 2, 5, 26, 40):
        assert not log.add(n, {"msg": "late"})
    assert found(log) == written
    assert glob.glob(f"{log.path}/**/.draft-*", recursive=True) == []


def test_bytes_written_do_not_grow_with_the_log(log):
    sizes = []
    for n in range(1, 31):
        log.append({"msg": "m" * 50})
        sizes.append(os.path.getsize(log._record(n)))
    assert max(sizes) <= min(sizes) + 1


@pytest.mark.parametrize("step", ["before the marker", "after the marker"])
def test_readers_and_writers_during_a_merge(log, monkeypatch, step):
    """Whatever happens while a table is published, all records are read once."""
    for n in range(1, 9):
        log.append({"msg": f"m{n}"})
    create, seen = files.create_once, []
    other = NumberedLog(log.spark, log.path, NOTES, fan=3)

    def hooked(spark, path, text):
        if "/merged/" not in path or seen:
            return create(spark, path, text)
        seen.append(path)
        if step.startswith("before"):
            # The other writer merges the same records first.
            other._merge(9)
            return create(spark, path, text)
        won = create(spark, path, text)
        assert found(other) == {n: f"m{n}" for n in range(1, 10)}
        return won

    monkeypatch.setattr(files, "create_once", hooked)
    log.append({"msg": "m9"})
    assert seen and found(log) == {n: f"m{n}" for n in range(1, 10)}
    tables = {files.read_text(log.spark, log._marker(*s)) for s in log._merged()}
    assert {f"tables/{name}" for name in os.listdir(f"{log.path}/tables")} == tables


def test_a_lost_merge_is_made_up_for(log, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(NumberedLog, "_merge", lambda *_: None)
        for n in range(1, 12):
            log.append({"msg": f"m{n}"})
    expected = {n: f"m{n}" for n in range(1, 12)}
    assert found(log) == expected
    log.compact()
    assert found(log) == expected and (1, 9) in log._merged()
    log.append({"msg": "m12"})
    assert found(log) == expected | {12: "m12"}
    # A hole that a lost writer has left is no reason to lose what follows.
    hole = NumberedLog(log.spark, log.path + "2", NOTES, fan=3)
    with monkeypatch.context() as patch:
        patch.setattr(NumberedLog, "_merge", lambda *_: None)
        for n in range(1, 4):
            hole.append({"msg": f"m{n}"})
    for n in range(4, 11):
        hole.append({"msg": f"m{n}"})
    assert found(hole) == {n: f"m{n}" for n in range(1, 11)}
