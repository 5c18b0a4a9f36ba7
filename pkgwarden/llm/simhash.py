"""SimHash near-duplicates: bit-sliced comparison within blocks, components over the links.

Words are the runs without ASCII white space of a text whose A-Z are lower-cased. Shingles of
``words`` words, repeats included, are hashed (XXH64, seed 42); a fingerprint bit is 1 if it is set
in over half of the hashes. A text of fewer words is one shingle; one of no words (null, empty) has
the fingerprint zero, which links like any other.

Fingerprints are compared within blocks. A block's fingerprints are turned into bit planes (one
64-bit word holds one bit of 64 fingerprints). The differing planes are summed by carry-save
adders into vertical counters that overflow exactly when a distance passes the radius, and a block
is given up once all its counters have overflowed.

Equal fingerprints are merged first, so copies cost nothing further. ``pigeonhole_keys`` gives the
blocks, exactly: fingerprints that differ in at most ``radius`` of 64 bits agree on at least
``parts - radius`` of ``parts`` parts; each choice of that many parts is a table of blocks.

A block of many fingerprints is cut into chunks and each two chunks meet in a task, so no task sees
more than two chunks and no pair is left out. A block's links are returned as a forest (each
fingerprint and one it is connected with), never as all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.codes import U64, mix, unused
from pkgwarden.llm.components import connected_components
from pkgwarden.sources.tables import settle

SEED = 42
#: Fingerprints of a block compared in one task: at most about twice as many.
CHUNK = 16_384
#: Fingerprints compared with the lanes at a time.
QUERIES = 64
#: Pairs of small blocks compared together.
PAIRS = 1 << 16
ALL = U64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints --------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, U64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), SEED)], U64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    slices = zip(starts, ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in slices), U64, len(starts))


def fingerprint(hashes: np.ndarray) -> bytes:
    """The majority bits of the hashes, big-endian; no hashes give zero."""
    if not len(hashes):
        return bytes(8)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes()


def pigeonhole_keys(radius: int, parts: int) -> np.ndarray:
    """Masks of the bits that the fingerprints of a block agree on, one for each table."""
    cuts = np.linspace(0, 64, parts + 1).astype(int)
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(parts)]
    chosen = itertools.combinations(masks, parts - radius)
    return np.array([sum(c) for c in chosen], U64)


# ---- bit-sliced comparison -----------------------------------------------------------------


def bit_planes(marks: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of bytes) as planes: one row a bit, 64 fingerprints a word."""
    bits = np.unpackbits(marks, axis=1).T
    lanes = -(-bits.shape[1] // 64) * 64
    padded = np.zeros((bits.shape[0], lanes), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(U64)


def padding(count: int, words: int) -> np.ndarray:
    """Lanes of the last word that hold nothing."""
    used = np.zeros(64 * words, np.uint8)
    used[count:] = 1
    return np.packbits(used, bitorder="little").view(U64)


def _add3(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three planes."""
    both = x ^ y
    return both ^ z, (x & y) | (z & both)


def outside(differing: Iterator[np.ndarray], radius: int, over: np.ndarray) -> np.ndarray:
    """Lanes whose number of differing planes passes the radius.

    The counters start so that they overflow at ``radius + 1``. Seven planes are added at a time:
    four carry-save adders give a sum of weight 1, 2 and 4. Stops once all lanes are over.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    counters = [np.full(over.shape, ALL if start >> i & 1 else U64(0)) for i in range(width)]

    def add(plane: np.ndarray, weight: int) -> None:
        for i in range(weight, width):
            counters[i], plane = counters[i] ^ plane, counters[i] & plane
        np.bitwise_or(over, plane, out=over)

    while planes := list(itertools.islice(differing, 7)):
        if len(planes) < 7:
            for plane in planes:
                add(plane, 0)
            break
        a, b, c, d, e, f, g = planes
        ones, twos_a = _add3(a, b, c)
        ones, twos_b = _add3(ones, d, e)
        ones, twos_c = _add3(ones, f, g)
        twos, fours = _add3(twos_a, twos_b, twos_c)
        add(ones, 0)
        add(twos, 1)
        add(fours, 2)
        if (over == ALL).all():
            break
    return over


def near_lanes(queries: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each query (row) the lanes within the radius: a table of booleans."""
    planes = bit_planes(lanes)
    asked = np.unpackbits(queries, axis=1).astype(bool)
    over = np.tile(padding(len(lanes), planes.shape[1]), (len(queries), 1))
    differing = (
        planes[i][None, :] ^ np.where(asked[:, i], ALL, U64(0))[:, None]
        for i in range(planes.shape[0])
    )
    inside = ~outside(differing, radius, over)
    return np.unpackbits(inside.view(np.uint8), axis=1, bitorder="little")[:, : len(lanes)] == 1


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of two tables of fingerprints lie within the radius: one lane a pair."""
    planes = bit_planes(a ^ b)
    over = padding(len(a), planes.shape[1])
    inside = ~outside(iter(planes), radius, over)
    return np.unpackbits(inside.view(np.uint8), bitorder="little")[: len(a)] == 1


def block_labels(marks: np.ndarray, radius: int) -> np.ndarray:
    """Component of each fingerprint of a block: the smallest row number in it.

    A row is compared with the rows not yet asked. Where many of them are in its component already,
    only the others are looked at, so a dense group costs little more than its size.
    """
    labels = np.arange(len(marks))
    rest = labels.copy()
    while len(rest) > 1:
        own = labels[rest] == labels[rest[0]]
        if own.sum() >= QUERIES:
            asked, lanes = rest[own][:QUERIES], rest[~own]
            if not len(lanes):
                break
        else:
            asked, lanes = rest[:QUERIES], rest
        for query, hits in zip(asked, near_lanes(marks[asked], marks[lanes], radius), strict=True):
            touched = np.unique(np.append(labels[lanes[hits]], labels[query]))
            if len(touched) > 1:
                labels[np.isin(labels, touched)] = touched[0]
        rest = np.setdiff1d(rest, asked, assume_unique=True)
    return labels


# ---- Spark ---------------------------------------------------------------------------------

_LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
_KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("mark", T.BinaryType())])


def fingerprints(words: int) -> Callable:
    """A column function of texts: the fingerprint of each."""

    @F.pandas_udf(T.BinaryType())
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in texts], dtype=object)

    return compute


def pigeonhole_blocks(marks: DataFrame, radius: int, parts: int) -> DataFrame:
    """Each 64-bit fingerprint with its key in each table."""
    masks = pigeonhole_keys(radius, parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0).to_pylist()
            values = np.frombuffer(b"".join(column), ">u8").astype(U64)
            for table, mask in enumerate(masks):
                keys = mix((values & mask) ^ mix(np.full(1, table, U64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), batch.column(0).cast(pa.binary())],
                    ["key", "mark"],
                )

    return marks.select("mark").mapInArrow(work, _KEYED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints (rows of bytes) of each block of a sorted stream of (block..., mark)."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
        data = b"".join(batch.column(batch.num_columns - 1).to_pylist())
        marks = np.frombuffer(data, np.uint8).reshape(batch.num_rows, -1)
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if name is not None and (names[:, start] == name).all():
                held.append(marks[start:end])
                continue
            if held:
                yield np.concatenate(held)
            held, name = [marks[start:end]], names[:, start]
    if held:
        yield np.concatenate(held)


def _dealt(blocks: DataFrame, chunk: int) -> DataFrame:
    """Rows of blocks of more than one row, dealt so that each two chunks of a block (``key``)
    meet; ``low`` and ``high`` are these two."""
    # Counted within tasks first; written, so that both sides of the join can be split.
    sizes = settle(
        blocks.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    )
    chunks = F.ceil(F.col("size") / chunk)
    own = F.pmod(F.xxhash64("mark"), chunks)
    others = F.sequence(F.lit(0).cast("long"), chunks - 1)
    places = F.when(chunks == 1, F.array(F.struct(own.alias("low"), own.alias("high")))).otherwise(
        F.transform(
            F.filter(others, lambda i: i != F.col("own")),
            lambda i: F.struct(F.least(i, "own").alias("low"), F.greatest(i, "own").alias("high")),
        )
    )
    return (
        blocks.join(sizes, "key")
        .withColumn("own", own)
        .select("key", F.explode(places).alias("place"), "mark")
        .select("key", "place.low", "place.high", "mark")
    )


def _told(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(side, pa.binary()) for side in (a, b)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def block_links(blocks: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (``a``, ``b``) that connect the fingerprints of each block as their distances do.

    ``blocks`` has ``key`` and ``mark``; a pair that comes twice costs time only. It is read twice:
    hand over a written table.
    """
    dealt = (
        _dealt(blocks.select("key", "mark"), chunk)
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return _told(*([row.tobytes() for row in side] for side in (a, b)))

        def small() -> pa.RecordBatch:
            a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
            near = near_pairs(a, b, radius)
            return told(a[near], b[near])

        for marks in _runs(batches):
            if len(marks) <= 16:
                i, j = np.triu_indices(len(marks), 1)
                pairs.append((marks[i], marks[j]))
                waiting += len(i)
            else:
                labels = block_labels(marks, radius)
                linked = labels != np.arange(len(marks))
                yield told(marks[linked], marks[labels[linked]])
            if waiting >= PAIRS:
                yield small()
                pairs, waiting = [], 0
        if waiting:
            yield small()

    return dealt.mapInArrow(work, _LINKS)


def with_component(marked: DataFrame, links: DataFrame, first: str) -> DataFrame:
    """Add ``component``: the smallest ``first`` of the documents reachable from a document.

    ``marked`` (written; has ``mark``) is joined by fingerprint: copies of a text, which may be a
    third of all rows, are on the side of the join that can be split.
    """
    own = settle(marked.groupBy("mark").agg(F.min(first).alias("own")))
    labels = connected_components(links).withColumnRenamed("node", "mark")
    least = labels.join(own, "mark").groupBy("label").agg(F.min("own").alias("least"))
    reached = labels.join(least, "label").select("mark", "least")
    found = own.join(reached, "mark", "left")
    # Written, so that both sides of the last join are plain exchanges, which can be split.
    found = settle(found.select("mark", F.coalesce("least", "own").alias("component")))
    return marked.join(found, "mark")


def marked_components(
    texts: DataFrame, words: int = 3, radius: int = 3, parts: int = 5
) -> DataFrame:
    """``row``, ``mark`` (64-bit fingerprint) and ``component`` of texts, exactly.

    Texts are linked where their fingerprints differ in at most ``radius`` bits. The component is the
    smallest ``row`` reachable; nulls come last.
    """
    marked = settle(texts.select("row", fingerprints(words)("text").alias("mark")))
    blocks = settle(pigeonhole_blocks(marked.select("mark").distinct(), radius, parts))
    return with_component(marked, block_links(blocks, radius), "row")


def simhash_components(
    docs: DataFrame, words: int = 3, radius: int = 3, parts: int = 5, key: str = "doc_id"
) -> DataFrame:
    """``key``, ``mark`` and ``component`` of every document. Rows of one key are separate documents.

    Other columns of the documents are ignored.
    """
    found = marked_components(docs.select(F.col(key).alias("row"), "text"), words, radius, parts)
    return found.select(F.col("row").alias(key), "mark", "component")


def keep_one_of_each(
    docs: DataFrame, words: int = 3, radius: int = 3, parts: int = 5, key: str = "doc_id"
) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest key.

    Fingerprints decide alone. Copies and repeated rows are one group, as are all texts without words
    (their fingerprint is zero, which links like any other). Documents of one key are told apart by
    their text; a null key comes last. Returns all columns of ``docs``.
    """
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    order = F.struct(
        docs[key].isNull().alias("none"), docs[key].alias("id"), text_key.alias("text_key")
    )
    grouped = marked_components(docs.select(order.alias("row"), "text"), words, radius, parts)
    kept = settle(
        grouped.select("component").distinct().select(
            F.col("component.id").alias("kept_id"), F.col("component.text_key").alias("kept_key")
        )
    )
    on = docs[key].eqNullSafe(kept["kept_id"]) & (text_key == kept["kept_key"])
    found = docs.join(kept, on, "left_semi")
    # Repeated rows of one key and text are still there; each task keeps one of its own first.
    name = unused("text_key", docs.columns)
    return found.withColumn(name, text_key).dropDuplicates([key, name]).drop(name)
