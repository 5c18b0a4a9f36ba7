"""Lookup join and anti join that hold for a small, a large and a skewed side."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.operators.spread import SPREAD, spread_stored
from pkgwarden.sources.tables import settle

_CELL = "_cell"
_CELLS = "_cells"
_SHARE = "_share"
_SHARES = "_shares"
_MATCHED = "_matched"

#: Keys that a sketch of frequent keys follows, keys that it proposes, and groups in which sketches of
#: tasks are merged before the last merge.
FOLLOWED = 4_096
PROPOSED = 1_000
MERGED = 64
# Types that Spark's sketch takes.
_SKETCHED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


@dataclass(frozen=True)
class JoinLimits:
    """When a side is broadcast, and when a key is spread over several tasks.

    A key is hot if it has more than ``cell_rows`` entries in the lookup, or if its rows times its
    entries pass ``cell_pairs``. Neither bound grows with the tables.
    """

    broadcast_rows: int = 2_000_000
    broadcast_bytes: int = 64 << 20
    cell_rows: int = 100_000
    cell_pairs: int = 20_000_000


DEFAULT_LIMITS = JoinLimits()


@dataclass(frozen=True)
class Size:
    """Measured size of a frame."""

    rows: int
    bytes: int

    def fits(self, limits: JoinLimits) -> bool:
        return self.rows <= limits.broadcast_rows and self.bytes <= limits.broadcast_bytes


def _value_bytes(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    if isinstance(field.dataType, T.ArrayType):
        return F.lit(8) * F.coalesce(F.array_size(value), F.lit(0)).cast("bigint")
    return F.lit(8).cast("bigint")


def _size_columns(df: DataFrame) -> list[Column]:
    row_bytes = reduce(add, [_value_bytes(f) for f in df.schema.fields], F.lit(16))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"),
    ]


def measure(df: DataFrame) -> Size:
    """Count the rows and the bytes of their values (one aggregation, one row to the driver)."""
    found = df.agg(*_size_columns(df)).first()
    return Size(found["rows"], found["bytes"])


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    size: Size | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Left or inner join of ``rows`` with ``lookup`` on one key column.

    A lookup whose measured size is within the limits is broadcast, so ``rows`` is not shuffled
    at all. A larger one is joined by shuffle, and a hot key is cut on both sides: its entries into
    cells, its rows into shares, and each cell meets each share in a task of its own. ``size``
    saves the measurement where it is known.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    if size is None:
        if limits.broadcast_rows == 0:
            lookup = spread_stored(lookup)
        size = measure(lookup)
    if size.fits(limits):
        return rows.join(F.broadcast(lookup.drop(SPREAD)), key, how)
    return _cell_join(rows, lookup, key, how, limits)


def frequent_keys(df: DataFrame, key: str) -> DataFrame:
    """The key values that may be hot: ``PROPOSED`` at most, without duplicates.

    Every task summarises its keys in a sketch of bounded size, sketches are merged, and the most frequent
    keys of the last one are returned. A key with more than one in about ``3 / 4 * FOLLOWED`` rows is
    among them, whatever the order of the rows; the rows themselves are not shuffled.
    """
    group = (F.spark_partition_id() % MERGED).alias("part")
    accumulate = F.expr(f"approx_top_k_accumulate(`{key}`, {FOLLOWED})")
    parts = df.filter(F.col(key).isNotNull()).groupBy(group).agg(accumulate.alias("sketch"))
    estimate = F.expr(
        f"approx_top_k_estimate(approx_top_k_combine(sketch, {FOLLOWED}), {PROPOSED})"
    )
    # Grouped by a constant: without rows there is no sketch to look into.
    whole = parts.groupBy(F.lit(0).alias("all")).agg(estimate.alias("top"))
    top = whole.select(F.explode("top").alias("one"))
    return top.select(F.col("one.item").alias(key))


def _hot_keys(rows: DataFrame, lookup: DataFrame, key: str, limits: JoinLimits) -> DataFrame:
    """Each hot key with the number of cells of its entries and of shares of its rows.

    Only the keys that either side's sketch proposes are counted, exactly; a key that neither
    proposes is less than a task's share of the rows. Counting is done within tasks first.
    """
    present = F.col(key).isNotNull()
    entries, probes = lookup.filter(present), rows.filter(present)
    if isinstance(rows.schema[key].dataType, _SKETCHED):
        proposed = settle(
            frequent_keys(lookup, key).unionByName(frequent_keys(rows, key)).distinct()
        )
        # At most twice PROPOSED keys.
        entries, probes = (df.join(F.broadcast(proposed), key) for df in (entries, probes))
    entries = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    probes = probes.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    cells = F.ceil(F.col("n") / limits.cell_rows)
    shares = F.ceil(F.ceil(F.col("n") / F.col(_CELLS)) * F.col("m") / limits.cell_pairs)
    counted = entries.join(probes, key).withColumn(_CELLS, cells.cast("int"))
    return counted.withColumn(_SHARES, shares.cast("int")).filter(
        (F.col(_CELLS) > 1) | (F.col(_SHARES) > 1)
    ).select(key, _CELLS, _SHARES)


def _cell_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str, limits: JoinLimits
) -> DataFrame:
    lookup = spread_stored(lookup)
    hot = settle(_hot_keys(rows, lookup, key, limits))
    found = hot.agg(*_size_columns(hot), F.max(_SHARES).alias("shares")).first()
    if found["rows"] == 0:
        return rows.join(lookup.drop(SPREAD).hint("shuffle_merge"), key, how)
    kept = SPREAD in rows.columns
    if found["shares"] > 1:
        # The share of a row must not change when a task runs again.
        rows = spread_stored(rows)
    if Size(found["rows"], found["bytes"]).fits(limits):
        hot = F.broadcast(hot)
    cells, shares = (F.coalesce(F.col(c), F.lit(1)) for c in (_CELLS, _SHARES))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    own_share = F.pmod(F.col(SPREAD), shares) if SPREAD in rows.columns else F.lit(0)
    entries = (
        lookup.join(hot, key, "left")
        .withColumn(_CELL, F.pmod(F.col(SPREAD), cells))
        .withColumn(_SHARE, every(shares))
        .withColumn(_MATCHED, F.lit(True))
        .drop(_CELLS, _SHARES, SPREAD)
    )
    # Each row meets every cell of its key once, and so each entry of the key once.
    probes = (
        rows.join(hot, key, "left")
        .withColumn(_SHARE, own_share)
        .withColumn(_CELL, every(cells))
    )
    joined = probes.join(entries.hint("shuffle_merge"), [key, _CELL, _SHARE], how)
    if how == "left":
        # A hot key has entries, so a cell without one is no missing match.
        joined = joined.filter(F.col(_CELLS).isNull() | F.col(_MATCHED))
    return joined.drop(_CELL, _SHARE, _CELLS, _SHARES, _MATCHED, *([] if kept else [SPREAD]))


def rows_absent(
    candidates: DataFrame,
    existing: DataFrame,
    key: str,
    existing_key: str | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Candidates whose key is not in ``existing``, as ``NOT IN`` defines it.

    With nothing existing every candidate stays, a null key included; a null among the existing
    keys leaves none; otherwise a null candidate key is dropped.
    """
    keys = existing.select(F.col(existing_key or key).alias(key))
    found = keys.agg(F.count(key).alias("not_null"), *_size_columns(keys)).first()
    if found["rows"] == 0:
        return candidates
    if found["not_null"] < found["rows"]:
        return candidates.filter(F.lit(False))
    if Size(found["rows"], found["bytes"]).fits(limits):
        keys = F.broadcast(keys)
    else:
        # Written first: a join whose sides are plain exchanges can split a hot candidate key, one
        # above an aggregation can not.
        keys = settle(keys.distinct())
    return candidates.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")
