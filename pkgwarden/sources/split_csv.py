"""Delimited text whose quoted fields hold line breaks, read by as many tasks as a file has splits.

Spark reads such a file unsplit, as a line tells nothing about whether a quote is open where it begins.
Here the lines of every split are counted first: an odd number of quotes changes whether one is open,
so the exclusive running sum (modulo 2) over the splits of a file gives the state at the beginning of
each. A second pass then cuts every split into records: lines are joined while a quote is open; what
a split begins with belongs to the last record of the split before, and these pieces are put together.
The records are written once; types are inferred from them and they are parsed by Spark's own parser.

This holds for text in which a quote opens a field at its beginning only and closes it at its end
(doubled inside). A line that breaks the rule is found in the second pass, and its file is left to the
unsplit reader, as is a file whose lines end in carriage returns only.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources.splits import (
    ATTEMPTS,
    HEAD,
    IRREGULAR,
    MOVED,
    RECORD,
    TAIL,
    SplitsMoved,
    assembled,
    lines_with_splits,
)
from pkgwarden.sources.tables import settle

_PIECE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("crlf", T.BooleanType()),
        T.StructField("header", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Split:
    """What one task reads of a file without a break, and whether a quote is open at its beginning.

    ``crlf`` tells that the file's first line, and so its line breaks, end in a carriage return.
    """

    file: str
    start: int
    length: int
    odd: bool
    long: bool
    crlf: bool
    inside: bool = False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return lines_with_splits(spark, path, "\n")


def _number_of(text: Column, found: str) -> Column:
    """By bytes: characters would have to be counted one by one."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(found), F.lit("")))
    return (removed / len(found.encode())).cast("bigint")


def _returns_within(text: Column) -> Column:
    """Whether a text has a carriage return that is not its last character."""
    return F.contains(text, F.lit("\r")) & (F.instr(text, "\r") < F.length(text))


def splits(spark: SparkSession, path: str | list[str], quote: str = '"') -> list[Split]:
    """The splits of all files, in order. One row a split comes to the driver.

    ``long`` tells that a record may go on in the next line: a line has an odd number of quotes, or a
    carriage return that does not end it.
    """
    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    quotes = _number_of(F.col("value"), quote)
    found = lines.groupBy("file", "start", "length").agg(
        (F.sum(quotes) % 2 == 1).alias("odd"),
        F.max((quotes % 2 == 1) | _returns_within(F.col("value"))).alias("long"),
        F.min_by(F.endswith(F.col("value"), F.lit("\r")), "at").alias("crlf"),
    )
    ordered, file, inside, crlf = [], None, False, False
    for row in sorted(found.collect(), key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, inside, crlf = row["file"], False, row["crlf"]
        ordered.append(Split(file, row["start"], row["length"], row["odd"], row["long"], crlf, inside))
        inside ^= row["odd"]
    return ordered


def _line_patterns(delimiter: str, quote: str) -> tuple[re.Pattern, re.Pattern]:
    """What a line looks like that begins outside and inside of a quoted field."""
    q, d = re.escape(quote), re.escape(delimiter)
    body = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    plain = rf"[^{q}{d}\r]*+(?!{q})"
    more = rf"(?:{d}(?:{q}{body}{q}|{plain}))*+(?:{d}{q}{body})?\r?"
    outside = rf"(?:{q}{body}(?:{q}{more})?|{plain}{more})"
    return re.compile(outside, re.DOTALL), re.compile(rf"{body}(?:{q}{more})?", re.DOTALL)


def _pieces(lines: DataFrame, known: list[Split], delimiter: str, quote: str) -> DataFrame:
    """Records of each split, and what it has of records that begin or end in another."""
    shared = lines.sparkSession.sparkContext.broadcast(
        {(s.file, s.start): (s.length, s.inside, s.crlf) for s in known}  # a row a split
    )

    def told(file: str, start: int, kind: int, header: list[bool], texts) -> pa.RecordBatch:
        count = len(texts)
        crlf = shared.value.get((file, start), (0, 0, False))[2]
        columns = [[file] * count, [start] * count, [kind] * count, [crlf] * count, header, texts]
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        arrays = [
            c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t)
            for c, t in zip(columns, types, strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, _PIECE.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = shared.value
        patterns = _line_patterns(delimiter, quote)
        split, opened, inside, at, head = None, [], False, 0, False

        def rest() -> Iterator[pa.RecordBatch]:
            """What is open where a split ends."""
            if split is not None and (opened or head):
                kind = HEAD if head else TAIL
                first = split[1] == 0 and not head and at == len(opened)
                yield told(*split, kind, [first], ["\n".join(opened)])

        for batch in batches:
            files, starts, lengths, values = batch.columns
            starts_of = starts.to_numpy()
            # The rows of a split come one after another.
            changes = np.flatnonzero(np.diff(starts_of)) + 1
            cuts = {0, *changes.tolist(), batch.num_rows}
            names = files.dictionary_encode().indices.to_numpy()
            cuts |= set((np.flatnonzero(np.diff(names)) + 1).tolist())
            cuts = sorted(cuts)
            for begin, end in zip(cuts, cuts[1:], strict=False):
                name, start = files[begin].as_py(), int(starts_of[begin])
                if split != (name, start):
                    yield from rest()
                    split, opened, at = (name, start), [], 0
                    length, inside, _ = states.get(split, (None, False, False))
                    head = inside
                    if length != lengths[begin].as_py():
                        yield told(name, start, MOVED, [False], [None])
                        return
                own = values.slice(begin, end - begin)
                quotes = pc.count_substring(own, quote).to_numpy(zero_copy_only=False)
                after = (np.cumsum(quotes) + inside) % 2 == 1
                before = np.append(inside, after[:-1])
                special = (quotes > 0) | pc.match_substring(own, "\r").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(special).tolist():
                    if not patterns[int(before[i])].fullmatch(own[i].as_py()):
                        yield told(name, start, IRREGULAR, [False], [None])
                        break
                whole = ~before & ~after
                ends, joined = [], []
                for i in np.flatnonzero(~whole).tolist():
                    opened.append(own[i].as_py())
                    if after[i]:
                        continue
                    text = "\n".join(opened)
                    if head:
                        yield told(name, start, HEAD, [False], [text])
                    else:
                        joined.append(text)
                        ends.append(i)
                    first = start == 0 and not head and at + i + 1 == len(opened)
                    opened, head = [], False
                    if first:
                        yield told(name, start, RECORD, [True], [joined.pop()])
                        ends.pop()
                places = np.flatnonzero(whole)
                if start == 0 and at == 0 and len(places) and places[0] == 0:
                    yield told(name, start, RECORD, [True], own.slice(0, 1))
                    places = places[1:]
                # In the order of their last lines.
                texts = pa.concat_arrays([own.take(pa.array(places, pa.int64())), pa.array(joined, own.type)])
                order = np.argsort(np.append(places, ends), kind="stable")
                if len(order):
                    yield told(name, start, RECORD, [False] * len(order), texts.take(pa.array(order)))
                at, inside = at + len(own), bool(after[-1])
        yield from rest()

    return lines.mapInArrow(work, _PIECE)


def read_records(
    spark: SparkSession, files: list[str], known: list[Split], delimiter: str, quote: str
) -> tuple[DataFrame, list[str]]:
    """Records (``file, header, text``) of files, as text, and the files that do not keep the rule.

    Files are named as their splits name them. They are read once here; the records are written.
    """
    paths = [unquote(f) for f in files]
    for _ in range(ATTEMPTS):
        own = [s for s in known if s.file in files]
        pieces = settle(_pieces(_lines(spark, paths), own, delimiter, quote))
        odd = pieces.filter(F.col("kind").isin(IRREGULAR, MOVED)).select("file", "kind").distinct()
        found = odd.collect()  # a row a file
        if all(row["kind"] == IRREGULAR for row in found):
            break
        known = splits(spark, paths, quote)
    else:
        raise SplitsMoved(f"the splits of {paths} differ each time they are read")
    irregular = sorted({row["file"] for row in found})
    regular = pieces.filter(~F.col("file").isin(irregular)) if irregular else pieces
    whole = regular.filter(F.col("kind") == RECORD).select("file", "crlf", "header", "text")
    records = whole.union(assembled(regular, "\n", ["crlf", "header"]))
    # As the parser has it where the lines of a file end so.
    text = F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    return records.withColumn("text", F.regexp_replace(text, r"\r\z", "")).filter("header OR text <> ''"), irregular


def header_names(records: DataFrame, delimiter: str, quote: str) -> list[str]:
    """The column names, which must be the same in all files. A row a different header is read."""
    texts = [row["text"] for row in records.filter("header").select("text").distinct().collect()]
    found = {
        tuple(next(csv.reader(io.StringIO(t.removeprefix("\ufeff")), delimiter=delimiter, quotechar=quote)))
        for t in texts
    }
    if len(found) != 1:
        raise ValueError(f"the files have different headers: {sorted(found)}")
    return list(found.pop())


def inferred(records: DataFrame, names: list[str], options: dict) -> T.StructType:
    """The types that Spark's own reader infers from the records."""
    spark = records.sparkSession
    rows = records.filter("NOT header").select("text")
    # The reader takes a data set of texts, which Python has no name for.
    texts = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.options(**options, inferSchema=True, header=False)
    kinds = [f.dataType for f in DataFrame(reader._jreader.csv(texts), spark).schema.fields]
    kinds += [T.StringType()] * (len(names) - len(kinds))
    return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])


def parsed(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The columns of the records."""
    ddl = ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields
    )
    row = F.from_csv("text", ddl, options)
    return records.filter("NOT header").select(row.alias("row")).select("row.*")
