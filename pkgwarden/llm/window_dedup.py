"""Substring dedup: every window of words that also starts earlier is removed.

Words are the runs without ASCII white space. Each window of ``size`` consecutive words of a
document has a Rabin-Karp hash (a polynomial over the words' 64-bit hashes modulo 2^64, scrambled),
and 16 bits of a second one over other hashes of the words as a check; "hash" below means all 80 bits.
A window is repeated if its hash also starts earlier: in a document of a smaller id, or earlier in
the same one. Repeated windows merge into maximal intervals of words, which are removed.

The documents are dealt out by ascending ranges of ids, called batches. A batch sends each distinct
hash once, packed by shares of the hash space, so a passage that a third of all documents hold
costs one entry a batch. A share knows the batches of each hash; the first keeps it, and every other
batch is told that the hash is known. A batch then takes a window as repeated if its hash was told
or starts earlier in the batch. Batches being ascending, no positions have to be sent.

Documents of one id follow each other by text; documents without an id come last. Null, empty
and short texts have no window and stay as they are. Two different windows share a hash with a
chance of about n^2 / 2^81 for n windows: 1 in 100,000 for 30 GB of texts; about a hundred of the 10^13
windows of 100 TB. Each byte more of the check costs a quarter of the input in shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pkgwarden.llm.codes import U64, Words, chunks, mix
from pkgwarden.llm.ordering import range_bounds, range_of

WINDOW = 20
#: Characters a batch holds in the mean; there are at least two batches a shuffle partition.
BATCH_CHARS = 12_000_000
_BASE = 0xD6E8FEB86659FD93
_CHECK_BASE = 0xA0761D6478BD642F
#: Bytes of the second hash.
_CHECK_BYTES = 2


def _rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    rolled = np.zeros(len(words) - size + 1, U64)
    for i in range(size):
        rolled *= U64(base)
        rolled += words[i : len(words) - size + 1 + i]
    return rolled


def window_hashes(
    words: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and checks of all windows that lie within one document, and the word each starts at.

    ``words`` are the words' hashes of several documents, ``offsets`` the first word of each and
    the end.
    """
    if len(words) < size:
        return np.empty(0, U64), np.empty(0, np.uint32), np.empty(0, np.int64)
    rolled = _rolled(words, size, _BASE)
    checks = _rolled(mix(words + U64(_CHECK_BASE)), size, _CHECK_BASE)
    counts = np.diff(offsets)
    long = counts >= size
    # +1 where a document's windows begin, -1 after the last of them.
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, offsets[:-1][long], 1)
    np.add.at(steps, offsets[1:][long] - size + 1, -1)
    inside = np.cumsum(steps)[: len(rolled)] > 0
    starts = np.flatnonzero(inside)
    short = (mix(checks[starts]) >> U64(64 - 8 * _CHECK_BYTES)).astype(np.uint32)
    return mix(rolled[starts]), short, starts


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each value."""
    size = values.dtype.itemsize
    table = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, size)
    return np.ascontiguousarray(table[:, :width]).tobytes()


def _from_low_bytes(data: bytes, offset: int, count: int, width: int, kind: type) -> np.ndarray:
    table = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
    table[:, :width] = np.frombuffer(data, np.uint8, count * width, offset).reshape(count, width)
    return table.view(np.dtype(kind).newbyteorder("<")).ravel().astype(kind)


def pack_hashes(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    """Steps from hash to hash, in as many bytes as the widest takes, then the checks.

    Ascending hashes of a batch lie close together: a million of them take six bytes each.
    """
    steps = np.diff(hashes, prepend=U64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _low_bytes(steps, width) + _low_bytes(checks, _CHECK_BYTES)


def unpack_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    count = (len(data) - 1) // (width + _CHECK_BYTES)
    steps = _from_low_bytes(data, 1, count, width, np.uint64)
    checks = _from_low_bytes(data, 1 + count * width, count, _CHECK_BYTES, np.uint32)
    return np.cumsum(steps, dtype=U64), checks


def unpack_all(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and checks of several packed lists, one after another, and the list of each."""
    found = [unpack_hashes(blob) for blob in blobs]
    hashes = np.concatenate([np.empty(0, U64), *(h for h, _ in found)])
    checks = np.concatenate([np.empty(0, np.uint32), *(c for _, c in found)])
    return hashes, checks, np.repeat(np.arange(len(found)), [len(h) for h, _ in found])


def again(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal ones together, the first as they came, and whether each in it is
    equal to the one before."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return order, same


def held_in(
    hashes: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray
) -> np.ndarray:
    """Which are among the known ones."""
    found = np.zeros(len(hashes), bool)
    if not len(known):
        return found
    order, _ = again(known, known_checks)
    known, known_checks = known[order], known_checks[order]
    at = np.searchsorted(known, hashes)
    # Several known ones with one hash differ in their checks: each is looked at.
    while (open_ := ~found & (at < len(known))).any():
        place = np.minimum(at, len(known) - 1)
        open_ &= known[place] == hashes
        if not open_.any():
            break
        found |= open_ & (known_checks[place] == checks)
        at = np.where(open_, at + 1, len(known))
    return found


def covered(starts: np.ndarray, size: int, count: int) -> np.ndarray:
    """Words that the windows of these starts cover: the union of their intervals."""
    steps = np.zeros(count + 1, np.int64)
    steps[starts] += 1
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps)[:count] > 0


def _in_order(ids: np.ndarray, texts: list[str]) -> list[int]:
    missing = pd.isna(ids)
    return sorted(
        range(len(texts)), key=lambda i: (missing[i], 0 if missing[i] else ids[i], texts[i])
    )


class _Batch:
    """The documents of a batch in order, and the hashes of their windows."""

    def __init__(self, frame: pa.Table, size: int) -> None:
        ids = np.array(frame.column("id").to_pylist(), dtype=object)
        texts = [t or "" for t in frame.column("text").to_pylist()]
        order = _in_order(ids, texts)
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.size = size
        hashes, checks, starts, counts, base = [], [], [], [], 0
        for part in chunks(self.texts):
            words = Words(self.texts[part])
            own, check, at = window_hashes(words.hashes(), words.offsets, size)
            hashes.append(own)
            checks.append(check)
            starts.append(at + base)
            counts.append(words.counts)
            base += int(words.offsets[-1])
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, U64)
        self.checks = np.concatenate(checks) if checks else np.empty(0, np.uint32)
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.counts = np.concatenate(counts) if counts else np.empty(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        order, same = again(self.hashes, self.checks)
        return self.hashes[order][~same], self.checks[order][~same]

    def repeated(self, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Starts of the windows whose hash is known or starts earlier in the batch."""
        order, same = again(self.hashes, self.checks)
        gone = np.zeros(len(order), bool)
        gone[order] = same
        return self.starts[gone | held_in(self.hashes, self.checks, *known)]

    def kept(self, known: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
        """(id, words, removed words, kept words joined by one space, removed intervals)."""
        gone = covered(self.repeated(known), self.size, int(self.counts.sum()))
        at = 0
        for key, text, count in zip(self.ids, self.texts, self.counts.tolist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            removed = gone[at : at + count]
            edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
            spans = [
                {"first": int(s), "end": int(e)}
                for s, e in zip(edges[0::2], edges[1::2], strict=True)
            ]
            left = [w for w, r in zip(words, removed.tolist(), strict=True) if not r]
            yield key, count, int(removed.sum()), b" ".join(left).decode(), spans
            at += count


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW
) -> DataFrame:
    """Each document without its repeated windows.

    Returns the key, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space)
    and ``spans`` (the removed intervals of words, end exclusive).
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    total = frame.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(2 * partitions, -(-total // BATCH_CHARS))
    batch = range_of(range_bounds(frame, "id", count))(F.col("id"))
    dealt = frame.select(batch.alias("batch"), "id", "text").repartition("batch")

    # Shares are the leading bits of a hash, so a share's hashes lie next to each other once sorted.
    bits = max(1, int(count - 1).bit_length())

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        hashes, checks = _Batch(table, size).distinct()
        share = (hashes >> U64(64 - bits)).astype(np.int64)
        names, first = np.unique(share, return_index=True)
        ends = np.append(first[1:], len(hashes))[: len(first)]
        blobs = [pack_hashes(hashes[s:e], checks[s:e]) for s, e in zip(first, ends, strict=True)]
        return pa.table(
            {
                "share": pa.array(names, pa.int64()),
                "batch": pa.array([key[0].as_py()] * len(names), pa.int64()),
                "hashes": pa.array(blobs, pa.binary()),
            }
        )

    packed = dealt.groupBy("batch").applyInArrow(pack, "share long, batch long, hashes binary")

    def compare(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_numpy()
        blobs = table.column("hashes").to_pylist()
        order = np.argsort(batches, kind="stable")
        hashes, checks, of = unpack_all([blobs[i] for i in order])
        owner = batches[order][of]
        # Stable: among equal hashes the smallest batch comes first.
        by_hash, later = again(hashes, checks)
        told, at = owner[by_hash][later], by_hash[later]
        order = np.argsort(told, kind="stable")
        names, first = np.unique(told[order], return_index=True)
        ends = np.append(first[1:], len(told))[: len(first)]
        at = at[order]
        packs = [pack_hashes(hashes[at[s:e]], checks[at[s:e]]) for s, e in zip(first, ends, strict=True)]
        return pa.table(
            {"batch": pa.array(names, pa.int64()), "known": pa.array(packs, pa.binary())}
        )

    known = packed.groupBy("share").applyInArrow(compare, "batch long, known binary")

    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField(
                "spans",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]
                    )
                ),
            ),
        ]
    )

    def apply(own: pa.Table, told: pa.Table) -> pa.Table:
        known = unpack_all(told.column("known").to_pylist())[:2]
        rows = list(_Batch(own, size).kept(known))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        arrow = to_arrow_schema(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], arrow)

    return dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(apply, schema)
