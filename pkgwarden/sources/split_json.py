"""One large JSON array of objects, read by as many tasks as its file has splits.

Spark reads such a file unsplit. Here it is read as lines that end with ``}``, so it is split wherever the
line breaks are. What is inside a string, and how deep an object lies, depends on what comes before a
split: each split tells for both cases (a string is open where it begins, or not) whether one is open at its end
and how much deeper it ends, and these are combined over the splits of a file. A second pass cuts the
elements out; what a split begins with belongs to the last element of the split before. The elements are
written once and parsed by Spark's own parser.

A file that is no array of objects is left to the unsplit reader; one that ends inside a string or an
element is malformed and raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
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

_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _LIST, _END = (ord(c) for c in '"\\{}[]')
_FILLING = np.isin(np.arange(256), [ord(c) for c in " \t\r\n,"])

_STATE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("odd", T.BooleanType()),
        T.StructField("outside", T.LongType()),
        T.StructField("inside", T.LongType()),
    ]
)
_PIECE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


@dataclass(frozen=True)
class State:
    """A split, whether a string is open where it begins, and how many objects and arrays are."""

    file: str
    start: int
    length: int
    inside: bool
    depth: int


@dataclass
class Structure:
    """What each byte of a text is: after it, the depth and whether a string is open; the brackets."""

    inside: np.ndarray
    depth: np.ndarray
    opens: np.ndarray
    closes: np.ndarray


def structure(data: np.ndarray, inside: bool, depth: int) -> Structure:
    """The structure of some bytes, given the state before them."""
    quotes = data == _QUOTE
    back = data == _BACKSLASH
    if back.any():
        # A quote after an odd number of backslashes is part of the string.
        plain = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        run = np.arange(len(data)) - 1 - np.append(-1, plain[:-1])
        quotes &= run % 2 == 0
    within = (np.cumsum(quotes) + inside) % 2 == 1
    opens = ((data == _OPEN) | (data == _LIST)) & ~within
    closes = ((data == _CLOSE) | (data == _END)) & ~within
    return Structure(within, depth + np.cumsum(opens.astype(np.int64) - closes), opens, closes)


def _bytes(values: pa.Array) -> np.ndarray:
    """The lines with the brackets that ended them. One is added at the end of a file as well."""
    joined = "}".join([*values.to_pylist(), ""]).encode("utf-8", "surrogatepass")
    return np.frombuffer(joined, np.uint8)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, pa.Array]]:
    """File, start and length of each split that a batch has lines of, and the lines."""
    files, starts, lengths, values = batch.columns
    names = files.dictionary_encode().indices.to_numpy()
    starts = starts.to_numpy()
    cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1
    cuts = [0, *cuts.tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        if end > begin:
            yield files[begin].as_py(), int(starts[begin]), lengths[begin].as_py(), values.slice(begin, end - begin)


def states(spark: SparkSession, paths: list[str]) -> list[State]:
    """The splits of all files with their states. A few rows a split come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row for each batch of a split; whether a string is open may change what follows, so both
        # cases are followed.
        place = 0
        for batch in batches:
            rows = []
            for file, start, length, values in _runs(batch):
                data = _bytes(values)
                cases = [structure(data, inside, 0) for inside in (False, True)]
                odd = bool(cases[0].inside[-1])
                rows.append((file, start, length, place, odd, *(int(c.depth[-1]) for c in cases)))
                place += 1
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], _STATE.names
            )

    found = lines_with_splits(spark, paths, "}").mapInArrow(work, _STATE).collect()
    known: list[State] = []
    file, inside, depth = None, False, 0
    for row in sorted(found, key=lambda r: (r["file"], r["start"], r["place"])):
        if row["file"] != file:
            _require_whole(file, inside, depth)
            file, inside, depth = row["file"], False, 0
        if not known or (known[-1].file, known[-1].start) != (file, row["start"]):
            known.append(State(file, row["start"], row["length"], inside, depth))
        depth += row["inside"] if inside else row["outside"]
        inside ^= row["odd"]
    _require_whole(file, inside, depth)
    return known


_STATE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _require_whole(file: str | None, inside: bool, depth: int) -> None:
    # The bracket added after the last line closes nothing; a file that ends with one has none added.
    if file is not None and (inside or depth not in (0, -1)):
        raise ValueError(f"malformed JSON: {unquote(file)} ends inside of a value")


def _pieces(lines: DataFrame, known: list[State]) -> DataFrame:
    """Elements of each split, and what it has of elements that begin or end in another."""
    shared = lines.sparkSession.sparkContext.broadcast(
        {(s.file, s.start): s for s in known}  # a row a split
    )
    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]

    def told(split: tuple[str, int], kind: int, texts: list) -> pa.RecordBatch:
        columns = [[split[0]] * len(texts), [split[1]] * len(texts), [kind] * len(texts), texts]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, _PIECE.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, opened, head, inside, depth = None, [], False, False, 0

        def rest() -> Iterator[pa.RecordBatch]:
            if split is not None and opened:
                yield told(split, HEAD if head else TAIL, [b"".join(opened).decode()])

        for batch in batches:
            for file, start, length, values in _runs(batch):
                if split != (file, start):
                    yield from rest()
                    split = (file, start)
                    state = shared.value.get(split)
                    if state is None or state.length != length:
                        yield told(split, MOVED, [None])
                        return
                    opened, inside, depth = [], state.inside, state.depth
                    head = depth > 1
                data = _bytes(values)
                own = structure(data, inside, depth)
                objects = own.opens & (data == _OPEN) & (own.depth == 2)
                ends = own.closes & (data == _CLOSE) & (own.depth == 1)
                between = (own.depth == 1) & ~ends & ~_FILLING[data] & ~own.closes & ~own.opens
                first = start == 0 and not opened and not head and depth == 0 and not inside
                lists = own.opens & (data == _LIST) & (own.depth == 2)
                top = own.opens & (own.depth == 1)
                wrong = between.any() or lists.any() or (first and top.any() and data[top.argmax()] != _LIST)
                if wrong:
                    yield told(split, IRREGULAR, [None])
                begins, stops = np.flatnonzero(objects), np.flatnonzero(ends) + 1
                texts = []
                if (opened or head) and len(stops):
                    text = b"".join([*opened, data[: stops[0]].tobytes()]).decode()
                    if head:
                        yield told(split, HEAD, [text])
                    else:
                        texts.append(text)
                    opened, head, stops = [], False, stops[1:]
                elif opened or head:
                    opened.append(data.tobytes())
                    begins = begins[:0]
                texts += [
                    data[a:b].tobytes().decode() for a, b in zip(begins, stops, strict=False)
                ]
                if len(begins) > len(stops):
                    opened = [data[begins[-1] :].tobytes()]
                if texts:
                    yield told(split, RECORD, texts)
                inside, depth = bool(own.inside[-1]), int(own.depth[-1])
        yield from rest()

    return lines.mapInArrow(work, _PIECE)


def read_elements(spark: SparkSession, files: list[str]) -> tuple[DataFrame, list[str]]:
    """Elements (``file, text``) of the arrays in files, and the files that hold something else.

    Each file is read twice, by all its splits; the elements are written.
    """
    for _ in range(ATTEMPTS):
        known = states(spark, files)
        pieces = settle(_pieces(lines_with_splits(spark, files, "}"), known))
        odd = pieces.filter(F.col("kind").isin(IRREGULAR, MOVED)).select("file", "kind").distinct()
        found = odd.collect()  # a row a file
        if all(row["kind"] == IRREGULAR for row in found):
            break
    else:
        raise SplitsMoved(f"the splits of {files} differ each time they are read")
    irregular = sorted({row["file"] for row in found})
    regular = pieces.filter(~F.col("file").isin(irregular)) if irregular else pieces
    whole = regular.filter(F.col("kind") == RECORD).select("file", "text")
    return whole.union(assembled(regular, "")), [unquote(f) for f in irregular]


def parsed(elements: DataFrame, schema: T.StructType) -> DataFrame:
    return elements.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
