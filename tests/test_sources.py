"""Feed readers: quoting, line breaks, types, malformed input."""

from __future__ import annotations

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources import (
    schemas,
    read_advisories,
    read_catalogue,
    read_delimited,
    read_key_values,
    split_csv,
    split_json,
    tables,
)

QUOTED = 'a;b;c\n1;"x;y ""q""";z\n2;"line1\nline2";""\n3;;"t"\n'
PLAIN = 'a;b;c\n1;"x;y ""q""";z\n2;"line1";""\n3;;"t"\n'


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_quotes_and_line_breaks(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, "q.csv", QUOTED), ["a", "b", "c"])
    assert [tuple(r) for r in df.collect()] == [
        ("1", 'x;y "q"', "z"),
        ("2", "line1\nline2", None),
        ("3", None, "t"),
    ]


def test_line_breaks_are_detected(spark, tmp_path):
    found = {
        name: [s.long for s in split_csv.splits(spark, write(tmp_path, f"{name}.csv", text))]
        for name, text in {"q": QUOTED, "p": PLAIN, "r": PLAIN.replace("line1", "a\rb")}.items()
    }
    assert found == {"q": [True], "p": [False], "r": [True]}


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that records begin and end anywhere in them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("150", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def csv_text(seed: int, rows: int, end: str = "\n") -> str:
    """Fields of all kinds: plain, quoted, empty, with doubled quotes, delimiters and line breaks."""
    draw = random.Random(seed)
    parts = ["a", 'say ""x""', "; ", "one\ntwo", "\n\n", "é漢", "", '""', "x\r\ny", "z" * 60, ";\n"]

    def field() -> str:
        if draw.random() < 0.5:
            return draw.choice(["", "7", "plain", "-1.5"])
        return '"' + "".join(draw.choice(parts) for _ in range(draw.randrange(4))) + '"'

    lines = ["a;b;Date/Publication;n"]
    lines += [f"{i};{field()};{field()};{draw.randrange(99)}" for i in range(rows)]
    return end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed", range(3))
def test_split_reading_equals_unsplit_reading(spark, tmp_path, small_splits, seed):
    end = "\r\n" if seed % 3 == 2 else "\n"
    path = write(tmp_path, "a b%20c.csv", csv_text(seed, 60, end))
    known = split_csv.splits(spark, path)
    assert len(known) > 10 and sum(s.inside for s in known) > 2
    assert split_csv._lines(spark, path).rdd.getNumPartitions() > 10
    whole = read_delimited(spark, path, ["b"], multi_line=True)
    found = read_delimited(spark, path, ["b"])
    assert found.schema == whole.schema
    assert found.schema["n"].dataType == T.IntegerType()
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    given = read_delimited(spark, path, schema=whole.schema)
    assert sorted(map(str, given.collect())) == sorted(map(str, whole.collect()))


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of a long field" for i in range(40))
    path = write(tmp_path, "t.csv", f'"a\n{long}";b\n1;"{long}"\n2;"{long}"\n')
    found = sorted(tuple(r) for r in read_delimited(spark, path).collect())
    assert found == [(1, long), (2, long)]
    assert read_delimited(spark, path).columns == [f"a\n{long}", "b"]


def test_files_of_all_kinds_together(spark, tmp_path, small_splits):
    """Plain ones, long ones, and such as only the unsplit reader takes as it does."""
    texts = [
        "a;b\n1;x\n2;y\n", 'a;b\n3;"x\ny"\n4;""\n', 'a;b\n5;6" pipe\n6;5" pipe\n',
        'a;b\n7;"u\nv"\n8;6" pipe\n', 'a;b\n9; "q" \n10;"x\n"\n',
    ]
    for i, text in enumerate(texts):
        write(tmp_path, f"all/{i}.csv", text)
    path = str(tmp_path / "all/*.csv")
    whole = read_delimited(spark, path, ["b"], multi_line=True)
    found = read_delimited(spark, path, ["b"])
    assert found.schema == whole.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_headers_of_split_files_must_agree(spark, tmp_path):
    write(tmp_path, "all/1.csv", 'a;b\n1;"x\ny"\n')
    write(tmp_path, "all/2.csv", 'a;c\n1;"x\ny"\n')
    with pytest.raises(ValueError, match="header"):
        read_delimited(spark, str(tmp_path / "all"), ["a", "b"])
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("z", T.StringType())])
    with pytest.raises(ValueError, match="header"):
        read_delimited(spark, str(tmp_path / "all/1.csv"), schema=schema)


def test_a_split_file_with_missing_fields_raises(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'a;b\n1;"x\ny"\n3\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_delimited(spark, path, ["a", "b"]).collect()


def test_splits_that_move_are_noticed(spark, tmp_path, small_splits):
    path = write(tmp_path, "t.csv", csv_text(1, 40))
    known = split_csv.splits(spark, path)
    stale = [dataclasses.replace(s, length=s.length + 1) for s in known]
    records, irregular = split_csv.read_records(spark, [known[0].file], stale, ";", '"')
    assert records.filter("NOT header").count() == 40 and irregular == []


def test_both_readings_agree_without_line_breaks(spark, tmp_path):
    path = write(tmp_path, "p.csv", PLAIN)
    whole = read_delimited(spark, path, ["b"], multi_line=True)
    split = read_delimited(spark, path, ["b"], multi_line=False)
    assert whole.schema == split.schema
    assert whole.collect() == split.collect()


def test_named_columns_stay_text_and_others_are_inferred(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, "t.csv", "v;n;d\n1.10;7;2024-01-05\n"), ["v", "d"])
    assert [f.dataType for f in df.schema] == [T.StringType(), T.IntegerType(), T.StringType()]
    assert tuple(df.first()) == ("1.10", 7, "2024-01-05")


def test_absent_text_column_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="Published"):
        read_catalogue(spark, write(tmp_path, "t.csv", "Package;Version\na;1\n"))


def test_header_must_match_a_given_schema(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("x", T.StringType())])
    path = write(tmp_path, "t.csv", "a;b\n1;2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, path, schema=schema).collect()


def test_record_with_missing_fields_raises(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a;b\n1;2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_delimited(spark, path, ["a", "b"]).collect()


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_advisories(spark, str(tmp_path / "ALL/*.json"))


def test_documents_over_many_lines_with_missing_and_extra_fields(spark, tmp_path):
    documents = [
        {"id": "A", "affected": [{"package": {"name": "p"}, "extra": 1}], "summary": "s"},
        {"id": "B"},
    ]
    for document in documents:
        write(tmp_path, f"ALL/{document['id']}.json", json.dumps(document, indent=2))
    found = read_advisories(spark, str(tmp_path / "ALL/*.json")).orderBy("id").collect()
    assert found[0]["affected"][0]["package"]["name"] == "p"
    assert found[0]["affected"][0]["ranges"] is None
    assert found[1]["affected"] is None


def test_corrupt_document_raises(spark, tmp_path):
    write(tmp_path, "ALL/a.json", '{"id": "A", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_advisories(spark, str(tmp_path / "ALL/*.json")).collect()


def test_key_values_as_array_and_as_lines(spark, tmp_path):
    items = [{"key": "Release", "value": " 4.5.3"}, {"key": "Date", "value": " 2026-01-02"}]
    array = write(tmp_path, "array.json", json.dumps(items, indent=1))
    lines = write(tmp_path, "lines.json", "\n".join(json.dumps(i) for i in items))
    expected = [tuple(i.values()) for i in items]
    assert [tuple(r) for r in read_key_values(spark, array).collect()] == expected
    assert [tuple(r) for r in read_key_values(spark, lines, True).collect()] == expected


def json_documents(seed: int, count: int) -> list[dict]:
    draw = random.Random(seed)
    texts = ["plain", 'a "quote" and \\', "}{][ ,", "line\nbreak", "é漢🙂", "\\\\\"", "", "}" * 30]
    return [
        {
            "id": draw.choice(texts) + str(i),
            "affected": [
                {"package": {"name": draw.choice(texts), "ecosystem": "E"},
                 "ranges": [{"events": [{"introduced": "0"}, {"fixed": draw.choice(texts)}]}] * draw.randrange(3)}
                for _ in range(draw.randrange(3))
            ],
            "other": [[1, {"x": []}], None, True],
        }
        for i in range(count)
    ]


@pytest.mark.parametrize(("seed", "indent"), [(0, None), (1, 1), (2, 4)])
def test_a_large_array_is_read_by_several_tasks(spark, tmp_path, small_splits, seed, indent):
    text = json.dumps(json_documents(seed, 25), indent=indent, ensure_ascii=seed % 2 == 0)
    path = write(tmp_path, "a b%20c.json", f" {text}\n")
    known = split_json.states(spark, [path])
    assert len(known) > 10 and any(s.inside for s in known) and len({s.depth for s in known}) > 2
    whole = spark.read.schema(schemas.ADVISORY).json(path, multiLine=True)
    found = read_advisories(spark, path)
    assert found.schema == whole.schema and whole.count() == 25
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_large_files_that_are_no_arrays_of_objects(spark, tmp_path, small_splits):
    documents = json_documents(3, 6)
    write(tmp_path, "ALL/object.json", json.dumps(documents[0] | {"more": ["x" * 400]}, indent=1))
    write(tmp_path, "ALL/array.json", json.dumps(documents, indent=1))
    write(tmp_path, "ALL/small.json", '{"id": "s"}')
    write(tmp_path, "ALL/empty.json", "[" + " " * 400 + "]")
    path = str(tmp_path / "ALL/*.json")
    whole = spark.read.schema(schemas.ADVISORY).json(path, multiLine=True)
    found = read_advisories(spark, path)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("cut", [3, 60])
def test_a_large_array_that_is_cut_off_raises(spark, tmp_path, small_splits, cut):
    path = write(tmp_path, "t.json", json.dumps(json_documents(5, 9))[:-cut])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_advisories(spark, path).collect()
    other = write(tmp_path, "u.json", '[{"id": "a"}, 7, {"id": "b"}' + ' , {"id": "c"}' * 40 + "]")
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        read_advisories(spark, other).collect()


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert tables.scratch_path(spark, "x").startswith(configured)
    assert tables.scratch_path(spark, "x") != tables.scratch_path(spark, "x")


class FakeSession:
    """Only what the choice of a shared folder looks at."""

    def __init__(self, **settings):
        self.conf = {name.replace("_", "."): value for name, value in settings.items()}
        self.sparkContext = type("Context", (), {"applicationId": "app-1"})


def test_only_a_local_session_gets_a_temporary_folder():
    local = FakeSession(spark_master="local[2]")
    assert tables.shared_dir(local) == tables.shared_dir(local)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(FakeSession(spark_master="yarn"))


def test_a_table_keeps_its_defaults(spark, tmp_path):
    """A writer that names neither the schema nor the defaults gets them."""
    path = str(tmp_path / "table")
    schema = schemas.defaulted(
        schemas.struct(ts=schemas.TIME, msg=schemas.STRING, n=T.IntegerType(), other=schemas.STRING),
        ts="current_timestamp()", n="6 * 7",
    )
    tables.create_if_missing(spark, path, schema)
    for i in range(3):
        rows = spark.createDataFrame([(f"m{i}",)], "msg string")
        tables.append(rows, path)
    tables.append(spark.createDataFrame([(1, "given")], "n long, msg string"), path)
    found = spark.read.parquet(path).orderBy("msg").collect()
    assert [(r.msg, r.n, r.other) for r in found] == [
        ("given", 1, None), ("m0", 42, None), ("m1", 42, None), ("m2", 42, None),
    ]
    assert all(r.ts is not None for r in found)
    assert spark.read.parquet(path).schema == schema
    with pytest.raises(ValueError, match="not in the table"):
        tables.append(spark.createDataFrame([(1,)], "unknown int"), path)
    # A table that is not there yet has the schema of its first rows, or the given one.
    new = str(tmp_path / "new")
    tables.append(spark.createDataFrame([("a",)], "msg string"), new, schema)
    tables.append(spark.createDataFrame([("b",)], "msg string"), new)
    assert {r.n for r in spark.read.parquet(new).collect()} == {42}


def test_quotes_and_returns_of_a_line_are_counted_by_bytes(spark):
    texts = ["", "\r", "a\r", "\ra", "\r\r", "ß\r", "ß\rß", 'x"ß""', '"', "«ß««", "ß"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    value = F.col("t")
    found = rows.select(
        "t",
        split_csv._number_of(value, '"').alias("quotes"),
        split_csv._number_of(value, "«").alias("wide"),
        split_csv._returns_within(value).alias("returns"),
    )
    for row in found.collect():
        t = row["t"]
        assert (row["quotes"], row["wide"], row["returns"]) == (t.count('"'), t.count("«"), "\r" in t[:-1]), t
