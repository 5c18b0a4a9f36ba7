"""Hard negatives from blocks of candidates along a Hilbert curve, chosen by their zone maps.

Candidates are ordered by their place on a Hilbert curve through the directions of the largest
variance and written in that order as Parquet, in blocks of ``BLOCK`` rows. A zone map holds the
smallest and largest entry of each dimension, and the labels, of every block. Interval arithmetic
bounds the inner product of an anchor and any row of a block: a block is read for an anchor only if
the bounds meet a window of scores that the anchor still looks for, and the block has a row of a
fitting label. Anchors are ordered and put into groups in the same way.

Positives and negatives are each found in two passes. The first reads the anchor's home block, where
its neighbours on the curve lie; the last of the scores found there is a floor that narrows the
window. The second reads whatever block the narrowed windows need. A task gets one group of anchors
and a few neighbouring blocks, and hands on the first rows of each window only.

Scores are exact integers. Defined results: rows whose id or label is null, whose vector is null,
holds null, nan or infinite entries, or has another length than most, take no part; of several rows
of one id the smallest label and vector counts; equal vectors are rows of their own, in the order of
their ids. Entries are limited so that a score fits a long (2^28 after scaling for 64 dimensions).
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.vectors import complete, matrix, of_one_length, scaled
from pkgwarden.sources.tables import settle

#: Rows of a block, neighbouring blocks read by one task, blocks of a file of the ordered table.
BLOCK = 1024
SPAN = 16
#: Anchors of a group, and zone maps that meet it in one task.
GROUP = 256
ZONES = 1024
#: Directions of the curve, and cells along each (as bits).
AXES = 8
BITS = 7
LOWEST, HIGHEST = -(1 << 62), 1 << 62


# ---- the curve -----------------------------------------------------------------------------


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of coordinates below ``2^bits``).

    The coordinates are turned into the transposed index (reflections and exchanges from the highest
    bit down, then a Gray code), whose bits are then read across the axes.
    """
    axes = [column.astype(np.int64) for column in cells.T]
    for bit in range(bits - 1, 0, -1):
        high, below = 1 << bit, (1 << bit) - 1
        for i, own in enumerate(axes):
            reflect = own & high != 0
            exchange = np.where(reflect, 0, (axes[0] ^ own) & below)
            axes[0] = np.where(reflect, axes[0] ^ below, axes[0] ^ exchange)
            if i:
                axes[i] = own ^ exchange
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where(axes[-1] & (1 << bit) != 0, flip ^ ((1 << bit) - 1), flip)
    place = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for own in axes:
            place = place << 1 | (own ^ flip) >> bit & 1
    return place


def curve_of(rows: DataFrame, dims: int) -> Column:
    """A column: the place of ``x`` on the curve, through the axes of the largest variance.

    Cells cover three deviations to both sides of the mean; what lies outside is in the last cell.
    Without dimensions there are no rows, and any place will do.
    """
    if not dims:
        return F.lit(0).cast("long")
    moments = []
    for i in range(dims):
        entry = F.col("x")[i].cast("double")
        moments += [F.avg(entry).alias(f"mean{i}"), F.stddev_pop(entry).alias(f"wide{i}")]
    found = rows.agg(*moments).first()
    mean = np.array([found[f"mean{i}"] or 0.0 for i in range(dims)])
    wide = np.array([found[f"wide{i}"] or 0.0 for i in range(dims)])
    axes = np.sort(np.argsort(-wide, kind="stable")[:AXES])
    low = (mean - 3 * wide)[axes]
    step = np.where(wide > 0, 6 * wide, 1.0)[axes] / (1 << BITS)

    @F.pandas_udf(T.LongType())
    def place(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="int64")
        cells = np.floor((matrix(column)[:, axes] - low) / step)
        return pd.Series(hilbert_index(np.clip(cells, 0, (1 << BITS) - 1), BITS))

    return place("x")


def in_blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Rows (with ``curve`` and ``id``) in the order of the curve, ``block`` numbering runs of at
    most ``size`` rows. The order is written, so that the numbers stay; blocks do not end with the
    files."""
    parts = max(1, -(-count // (size * SPAN)))
    placed = rows.repartitionByRange(parts, "curve", "id").sortWithinPartitions("curve", "id")
    fields = [T.StructField(name, T.LongType()) for name in ("part", "at")]
    schema = T.StructType(rows.schema.fields + fields)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for frame in batches:
            yield frame.assign(part=TaskContext.get().partitionId(), at=seen + np.arange(len(frame)))
            seen += len(frame)

    ordered = settle(placed.mapInPandas(number, schema))
    counted = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # A row a partition.
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    firsts = settle(counted.select("part", before.alias("first")))
    block = F.floor((F.col("first") + F.col("at")) / size).cast("long")
    return ordered.join(firsts, "part").withColumn("block", block).drop("part", "at", "first")


# ---- zone maps -----------------------------------------------------------------------------


def zone_maps(stored: DataFrame) -> DataFrame:
    """``block, low, high, labels`` of each block. A block that two tasks read is put together."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("low", T.ArrayType(T.LongType())),
            T.StructField("high", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(stored.schema["label"].dataType)),
        ]
    )

    def zone(block: int, low: np.ndarray, high: np.ndarray, labels) -> dict:
        return {"block": block, "low": low.min(0), "high": high.max(0), "labels": sorted(set(labels))}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            zones = []
            for block, own in frame.groupby("block"):
                x = matrix(own.x, np.int64)
                zones.append(zone(block, x, x, own.label))
            if zones:
                yield pd.DataFrame(zones)

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        low, high = matrix(own.low, np.int64), matrix(own.high, np.int64)
        labels = (label for labels in own.labels for label in labels)
        return pd.DataFrame([zone(own.block.iloc[0], low, high, labels)])

    partial = stored.select("block", "label", "x").mapInPandas(read, schema)
    return settle(partial.groupBy("block").applyInPandas(merge, schema))


def bounds(
    anchors: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor (row) with anything inside each box (column).

    An entry's product with an interval is least at one of its ends. The sums are moved outwards
    by what their rounding can amount to.
    """
    a = anchors.astype(np.float64)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    lo, hi = low.T.astype(np.float64), high.T.astype(np.float64)
    far = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)) * 1e-12
    return up @ lo + down @ hi - far, up @ hi + down @ lo + far


def needed_blocks(anchors: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """``group, block, who``: the blocks that anchors (positions in their group) must read.

    ``anchors`` has ``group, place, label, x, windows``. Every group meets the zone maps in chunks.
    """
    # One number: the chunks that the zone maps are dealt to.
    chunks = max(1, -(-zones.count() // ZONES))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks))
    all_chunks = F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))
    groups = anchors.select("group").distinct()
    left = anchors.select(
        "group", "place", "label", "x", "windows", F.explode(all_chunks).alias("chunk")
    )
    # Each group and chunk once; renamed, as the anchors are on the other side as well.
    meetings = groups.select(F.col("group").alias("by"), F.explode(all_chunks).alias("part"))
    spread = zones.withColumn("part", chunk).join(meetings, "part")

    def choose(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        chosen = []
        if len(a) and len(z):
            least, most = bounds(
                matrix(a.x, np.int64), matrix(z.low, np.int64), matrix(z.high, np.int64)
            )
            places, labels = a.place.to_numpy(), a.label.to_numpy()
            reach = np.zeros(least.shape, bool)
            for i, windows in enumerate(a.windows):
                for w in windows:
                    reach[i] |= (most[i] >= w["low"]) & (least[i] <= w["high"])
            for j, (block, own) in enumerate(zip(z.block, z.labels, strict=True)):
                held = np.asarray(own)
                fits = np.isin(labels, held) if same else (labels != held[0]) | (len(held) > 1)
                who = places[reach[:, j] & fits]
                if len(who):
                    chosen.append({"group": a.group.iloc[0], "block": block, "who": who})
        return pd.DataFrame(chosen, columns=["group", "block", "who"])

    return (
        left.groupBy("group", "chunk")
        .cogroup(spread.groupBy("by", "part"))
        .applyInPandas(choose, "group long, block long, who array<long>")
    )


# ---- meeting -------------------------------------------------------------------------------


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers; by doubles where these cannot round."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def first_of(values: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` largest values, in order, ties to the smaller id."""
    at = np.arange(len(values))
    if len(values) > count:
        at = np.flatnonzero(values >= np.partition(values, -count)[-count])
    return at[np.lexsort((ids[at], -values[at]))][:count]


def meet(
    anchors: DataFrame, pairs: DataFrame, stored: DataFrame, same: bool, count: int
) -> DataFrame:
    """``anchor, of, score, id``: the first rows of each window, among those of a task.

    ``anchors`` has ``group, place, id, label, x, windows``; a window has a name ``of``. ``pairs``
    (written) tells which anchors read which blocks.
    """
    span = F.floor(F.col("block") / SPAN)
    asked = pairs.withColumn("span", span)
    wanted = pairs.select(F.col("group").alias("by"), span.alias("part"), "block")
    who = F.sort_array(F.collect_list(F.struct("block", "who")))
    # Places of a group's anchors by block: a row a task.
    left = (
        anchors.groupBy("group")
        .agg(F.collect_list(F.struct("place", "id", "label", "x", "windows")).alias("anchors"))
        .join(asked.groupBy("group", "span").agg(who.alias("who")), "group")
    )
    right = stored.select("block", "id", "label", "x").join(wanted, "block")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            ids, labels, blocks = b.id.to_numpy(), b.label.to_numpy(), b.block.to_numpy()
            reads: dict[int, list[int]] = {}
            for entry in a.who.iloc[0]:
                for place in entry["who"]:
                    reads.setdefault(int(place), []).append(entry["block"])
            own = [one for one in a.anchors.iloc[0] if one["place"] in reads]
            table = scores(matrix([one["x"] for one in own], np.int64), matrix(b.x, np.int64))
            for one, line in zip(own, table, strict=True):
                fits = labels == one["label"] if same else labels != one["label"]
                fits &= np.isin(blocks, reads[one["place"]]) & (ids != one["id"])
                at = np.flatnonzero(fits)
                values = line[at]
                for w in one["windows"]:
                    inside = np.flatnonzero((values >= w["low"]) & (values <= w["high"]))
                    rows = at[inside]
                    rows = rows[first_of(line[rows], ids[rows], count)]
                    found += [(one["id"], w["of"], line[r], ids[r]) for r in rows]
        return pd.DataFrame(found, columns=["anchor", "of", "score", "id"])

    return (
        left.groupBy("group", "span")
        .cogroup(right.groupBy("by", "part"))
        .applyInPandas(work, "anchor long, of long, score long, id long")
    )


def ranked(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each window over all tasks, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def search(
    anchors: DataFrame, zones: DataFrame, stored: DataFrame, same: bool, count: int
) -> DataFrame:
    """The first ``count`` rows inside each window of each anchor, in two passes."""
    home = settle(
        anchors.groupBy("group", F.col("home").alias("block")).agg(F.collect_list("place").alias("who"))
    )
    near = ranked(meet(anchors, home, stored, same, count), count).filter(F.col("rank") == count)
    # The score of the last row found at home, for each window that is full already.
    floors = near.groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("of", "score"))).alias("floors")
    )
    narrowed = anchors.join(floors.withColumnRenamed("anchor", "id"), "id", "left").withColumn(
        "windows",
        F.transform(
            "windows",
            lambda w: F.struct(
                w["of"].alias("of"),
                F.greatest(w["low"], F.try_element_at("floors", w["of"])).alias("low"),
                w["high"].alias("high"),
            ),
        ),
    )
    narrowed = settle(narrowed.drop("floors"))
    pairs = settle(needed_blocks(narrowed, zones, same))
    return settle(ranked(meet(narrowed, pairs, stored, same, count), count))


@dataclass(frozen=True)
class Shares:
    """A negative's score lies between these hundredths of the positive's."""

    least: int = 30
    most: int = 90


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    shares: Shares = Shares(),
    factor: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are the ``positives`` other rows of its label of the largest inner
    product; each has up to ``negatives`` rows of other labels, by falling score within the shares
    of the positive's. ``is_anchor`` is a condition on the column ``id``.
    """
    own = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vec"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    whole, dims = of_one_length(own.filter(complete(F.col("vec"))), "vec")
    limit = 1 << (62 - max(dims, 1).bit_length()) // 2
    kept = whole.select("id", "label", scaled("vec", factor, limit=limit).alias("x"))
    one = F.min(F.struct("label", "x")).alias("one")
    rows = settle(kept.groupBy("id").agg(one).select("id", "one.*"))
    placed = rows.withColumn("curve", curve_of(rows, dims))
    stored = in_blocks(placed, BLOCK, rows.count())
    zones = zone_maps(stored)
    asked = stored.filter(is_anchor).withColumnRenamed("block", "home")
    grouped = in_blocks(asked, GROUP, asked.count()).withColumnRenamed("block", "group")
    place = F.row_number().over(Window.partitionBy("group").orderBy("curve", "id"))
    anchors = settle(
        grouped.withColumn("place", place.cast("long")).select("group", "place", "home", "id", "label", "x")
    )
    every = F.struct(
        F.lit(0).cast("long").alias("of"),
        F.lit(LOWEST).cast("long").alias("low"),
        F.lit(HIGHEST).cast("long").alias("high"),
    )
    near = search(anchors.withColumn("windows", F.array(every)), zones, stored, True, positives)
    # 100 n >= least p and 100 n <= most p, in whole numbers.
    window = F.struct(
        F.col("id").alias("of"),
        _whole_share("score", shares.least, True).alias("low"),
        _whole_share("score", shares.most, False).alias("high"),
    )
    windows = near.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(window).alias("windows"))
    hard = search(anchors.join(windows, "id"), zones, stored, False, negatives)
    found = hard.withColumnsRenamed({"of": "positive", "score": "low", "id": "negative"})
    names = near.select("anchor", F.col("id").alias("positive"), "score")
    return found.join(names, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"),
        F.col("low").alias("negative_score"),
    )


def _whole_share(score: str, hundredths: int, up: bool) -> Column:
    """``score * hundredths / 100`` rounded up or down, by whole numbers only."""
    product = F.col(score).cast("decimal(38,0)") * F.lit(hundredths)
    rounded = (F.ceil if up else F.floor)(product / F.lit(100))
    return rounded.cast("long")
