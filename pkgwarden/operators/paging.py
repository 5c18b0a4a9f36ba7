"""Pages of an ordered result, near its start and deep inside it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.operators.filters import all_of
from pkgwarden.operators.ordering import (
    Position,
    SortKey,
    comparable,
    copies,
    ordered,
    total_order,
)
from pkgwarden.sources.tables import settle
from pkgwarden.streaming.delivery import json_rows

# The page that is returned unless another one is asked for. So are the names of the
# envelope below.
DEFAULT_LIMIT = 100
DEFAULT_OFFSET = 0

# In a top-k each task keeps as many rows as the page ends at and hands them to one last task. A
# page is a plain top-k only within these bounds of its rows, its end and what all tasks hand over,
# counting a task per million rows.
PAGE_ROWS = 50_000
TOP_K_ROWS = 500_000
HANDED_ROWS = 20_000_000
ROWS_PER_TASK = 1_000_000
# Looking for the rows of a page: rows sampled at a time, and places compared in one counting
# pass. More places per pass make a comparison that the JVM no longer compiles well.
SAMPLED_ROWS = 5_000
SAMPLED_BYTES = 16 << 20
SPLITTERS = 15


@dataclass(frozen=True)
class Page:
    """One page with the number of rows of the whole result."""

    rows: DataFrame
    limit: int
    offset: int
    total: int

    def envelope(self) -> DataFrame:
        """The page as JSON rows, each with the paging information."""
        return json_rows(self.rows).select(
            "json",
            F.lit(self.limit).cast("bigint").alias("limit"),
            F.lit(self.offset).cast("bigint").alias("offset"),
            F.lit(self.total).cast("bigint").alias("total"),
        )

    def to_json(self) -> str:
        """``{"data": [...], "paging": {...}}``; brings the rows of this page to the driver."""
        # The rows' own text: reading numbers back would change them.
        data = ",".join(row["json"] for row in json_rows(self.rows).collect())
        paging = {"limit": self.limit, "offset": self.offset, "total": self.total}
        return f'{{"data": [{data}], "paging": {json.dumps(paging)}}}'


def paged(
    df: DataFrame,
    keys: Sequence[SortKey],
    limit: int = DEFAULT_LIMIT,
    offset: int = DEFAULT_OFFSET,
    total: int | None = None,
    stored: bool = False,
) -> Page:
    """A page and the total, which is counted unless it is known."""
    total = df.count() if total is None else total
    return Page(page(df, keys, limit, offset, total, stored=stored), limit, offset, total)


def page(
    df: DataFrame,
    keys: Sequence[SortKey],
    limit: int = DEFAULT_LIMIT,
    offset: int = DEFAULT_OFFSET,
    total: int | None = None,
    top_k_rows: int = TOP_K_ROWS,
    handed_rows: int = HANDED_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ordered frame.

    The order is completed by all other columns, so that consecutive pages fit together. A page
    near the start is a top-k, unless ``total``, the number of all rows if known (as it is to
    ``paged``), shows that the result is very large. Otherwise the rows of the page are looked up
    first, so that no task holds the skipped rows or a candidate page from every other task; this
    needs columns whose values can be written as text. Looking up reads the frame several times,
    so it is written once before, unless it is ``stored`` already.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    order = total_order(df, keys)
    textual = all(comparable(f.dataType) for f in df.schema.fields)
    near = limit <= min(PAGE_ROWS, top_k_rows) and offset + limit <= top_k_rows
    if total is None and (near or not textual):
        return ordered(df, order).offset(offset).limit(limit)
    if total is not None:
        end = min(offset + limit, total)
        if offset >= end:
            return df.filter(F.lit(False))
        if not textual or (near and end * -(-total // ROWS_PER_TASK) <= handed_rows):
            return ordered(df, order).offset(offset).limit(limit)
    if not stored:
        df = settle(df)
    if total is None:
        total = df.count()
        end = min(offset + limit, total)
        if offset >= end:
            return df.filter(F.lit(False))
    levels = [level for level in (order[: len(keys)], order[len(keys) :]) if level]
    pieces = _look_up(
        _Gap(df, None, None, total), levels, offset, end, min(top_k_rows, PAGE_ROWS)
    )
    # The pieces are exactly the rows of the page, so nothing is cut off after sorting.
    return ordered(reduce(DataFrame.unionByName, pieces), order)


@dataclass(frozen=True)
class _Gap:
    """The rows strictly between two places of the order, their number, and places among them.

    ``common`` holds the places that give the values which all rows of ``df`` share.
    """

    df: DataFrame
    lower: Position | None
    upper: Position | None
    rows: int
    pool: Sequence[Position] = ()
    common: tuple[Position, ...] = ()

    def frame(self) -> DataFrame:
        bounds = []
        if self.lower is not None:
            bounds.append(self.lower.rows_after())
        if self.upper is not None:
            bounds.append(self.upper.rows_before())
        return self.df.filter(all_of(bounds)) if bounds else self.df


def _look_up(
    gap: _Gap, levels: Sequence[Sequence[SortKey]], start: int, end: int, top_k_rows: int
) -> list[DataFrame]:
    """Frames that together hold rows ``start`` to ``end`` of a gap, ordered by all levels.

    Places in the order of the first level's columns are sampled, and the rows around some of them
    are counted: one pass that reads these columns only and sends a few counters per task. What
    lies wholly inside the page is taken as it is. A smaller gap that is cut by the start or the
    end is looked up in turn, with the sampled places inside it, or with new ones when none is
    left. The sample decides how fast this is, never what is found. Rows that are equal in these
    columns, however many, are looked up by the next level; rows equal in every column are the
    same row and are written down without reading them.
    """
    lead, deeper = levels[0], levels[1:]
    df = gap.frame()
    if start == 0 and end == gap.rows:
        return [df]
    if gap.rows <= top_k_rows:
        order = [key for level in levels for key in level]
        return [ordered(df, order).offset(start).limit(end - start)]
    pool = gap.pool or _sample_places(df, lead, gap.rows)
    step = -(-len(pool) // SPLITTERS)
    chosen = range(step // 2, len(pool), step)
    places = [pool[i] for i in chosen]
    counts = _count_around(df, places)

    pieces: list[DataFrame] = []
    inside: list[Column] | None = None  # bounds of the rows that lie wholly inside the page

    def close() -> None:
        nonlocal inside
        if inside is not None:
            pieces.append(df.filter(all_of(inside)))
        inside = None

    passed, below, first = 0, gap.lower, 0
    for i in range(len(places) + 1):
        place = places[i] if i < len(places) else None
        above, last = (place, chosen[i]) if place is not None else (gap.upper, len(pool))
        rows = (counts[i][0] if place is not None else gap.rows) - passed
        cut = max(start - passed, 0), min(end - passed, rows)
        if cut == (0, rows) and rows:
            low = [] if below is None else [below.rows_after()]
            inside = [inside[0] if inside else all_of(low)]
            inside.append(all_of([] if above is None else [above.rows_before()]))
        elif cut[0] < cut[1]:
            close()
            part = _Gap(gap.df, below, above, rows, pool[first:last], gap.common)
            pieces += _look_up(part, levels, *cut, top_k_rows)
        passed += rows
        if place is None:
            break
        equal = counts[i][1]
        cut = max(start - passed, 0), min(end - passed, equal)
        if cut == (0, equal):
            from_here = place.rows_equal() | place.rows_after()
            inside = [inside[0] if inside else from_here]
            inside.append(place.rows_equal() | place.rows_before())
        elif cut[0] < cut[1]:
            close()
            shared = (*gap.common, place)
            if deeper:
                group = _Gap(df.filter(place.rows_equal()), None, None, equal, (), shared)
                pieces += _look_up(group, deeper, *cut, top_k_rows)
            else:
                pieces.append(copies(gap.df, shared, cut[1] - cut[0]))
        passed, below, first = passed + equal, place, last + 1
    close()
    return pieces


def _sample_places(df: DataFrame, keys: Sequence[SortKey], rows: int) -> list[Position]:
    """Different places in ascending order, from about ``SAMPLED_ROWS`` of the frame's rows.

    Fewer are sampled where their values are long: about ``SAMPLED_BYTES`` come to the driver.
    """
    columns = df.select(*[F.col(f"`{key.column}`") for key in keys])
    types = tuple(f.dataType for f in columns.schema.fields)
    texts = [F.col(f"`{key.column}`").cast("string") for key in keys]
    long = F.sum(sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(16)))
    wanted = SAMPLED_ROWS
    if any(isinstance(t, T.StringType) for t in types):
        mean = (columns.agg(long).first()[0] or 0) / max(rows, 1)
        wanted = max(SPLITTERS, min(SAMPLED_ROWS, int(SAMPLED_BYTES / max(mean, 1))))
    fraction, seed = wanted / rows, 0
    while True:
        sample = columns.sample(min(1.0, fraction), seed)
        # The limit makes this a top-k, which needs no range sort; it is above the sample's size.
        rows_in_order = ordered(sample, keys).limit(2 * wanted)
        sampled = [tuple(row) for row in rows_in_order.select(*texts).collect()]
        if sampled:
            return [Position(tuple(keys), types, values) for values in dict.fromkeys(sampled)]
        if fraction >= 1.0:
            raise RuntimeError("the rows to be paged differ each time they are read")
        fraction, seed = 2 * fraction, seed + 1


def _count_around(df: DataFrame, places: Sequence[Position]) -> list[tuple[int, int]]:
    """For each place the number of rows before it and the number of rows equal to it.

    A row is compared with the middle place first and then only with the places on its side.
    Numbers from 0 on stand for: before the first place, equal to it, between it and the second,
    and so on. Each task sends one counter per number.
    """

    def number(first: int, last: int) -> Column:
        if first == last:
            return F.lit(2 * first)
        middle = (first + last) // 2
        return (
            F.when(places[middle].rows_before(), number(first, middle))
            .when(places[middle].rows_equal(), F.lit(2 * middle + 1))
            .otherwise(number(middle + 1, last))
        )

    counted = df.groupBy(number(0, len(places)).alias("number")).agg(F.count(F.lit(1)).alias("n"))
    found = {row["number"]: row["n"] for row in counted.collect()}
    before, counts = 0, []
    for i in range(len(places)):
        before += found.get(2 * i, 0)
        equal = found.get(2 * i + 1, 0)
        counts.append((before, equal))
        before += equal
    return counts
