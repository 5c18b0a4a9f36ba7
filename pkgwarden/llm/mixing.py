"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words. Sources share the total size by weight; a target
stops at ``MOST_COPIES`` times its source's size and the excess is shared anew. A source takes every
document ``floor(target / size)`` times. What is left of its target (less than its size) is fitted
with whole documents by their exact lengths: every length first gets its proportional number of
documents, rounded down; then a bounded-knapsack dynamic programme over the documents left
chooses how many of each length to add, so that the sum comes as near to the budget as these can come
without passing it. Where that misses the budget, fewer and fewer are given beforehand, at last none, so
that a budget within ``FITTED_WORDS`` gets the largest sum not above it that there is. Where single
documents do not meet the budget, the programme may add each up to
``MOST_COPIES`` times in all. Which documents of a length are taken is decided by a seeded hash of their id
and text, so runs agree.

Sources are told apart exactly, null is one of them; an empty or null text has size 0 and takes no
words. A source without words has the target 0. Repeated rows are separate documents. Texts of any length
are counted whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgwarden.llm.codes import unused
from pkgwarden.sources.tables import settle

MOST_COPIES = 3
SEED = 7
#: Words that the dynamic programme fits: documents go greedily, longest first, until so many are
#: left of the budget.
FITTED_WORDS = 1 << 17
#: Documents of one source and length that one task orders, in the mean.
SLICE_ROWS = 500


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def with_targets(
    sources: DataFrame, weights: tuple[float, ...], most: int = MOST_COPIES
) -> DataFrame:
    """Add ``target`` to one row a source (``source``, ``source_size``): the total by weight, capped at
    ``most`` times the size, the excess shared anew by weight.

    Sources that are capped have the smallest sizes for their weight: in that order a source is capped
    if it and all before it are above their cap when what those before leave is shared by the rest.
    """
    name = F.asc_nulls_last("source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(Window.orderBy(name)) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    weighed = sources.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), name).rowsBetween(
        Window.unboundedPreceding, -1
    )
    taken = lambda column: F.sum(column).over(everything) - F.coalesce(
        F.sum(column).over(before), F.lit(0)
    )
    shared = weighed.withColumns(
        {
            "left_words": F.sum("source_size").over(everything)
            - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "left_weight": taken("weight"),
            "place": F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), name)),
        }
    ).withColumn("above", F.col("left_words") * F.col("weight") / F.col("left_weight") > F.col("most"))
    first = F.min(F.when(~F.col("above"), F.struct("place", "left_words", "left_weight"))).over(everything)
    target = F.when(
        F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("most").cast("double")
    ).otherwise(F.col("first.left_words") * F.col("weight") / F.col("first.left_weight"))
    return shared.withColumn("first", first).select("source", "source_size", target.alias("target"))


def fit_budget(
    lengths: np.ndarray, counts: np.ndarray, budget: int, least: np.ndarray | None = None
) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near the budget.

    Never passes it; ``counts`` bounds each length. ``least`` (by default the proportional numbers,
    rounded down) is taken first; while the sum misses the budget, less of it is.
    """
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= whole:
        return counts.astype(np.int64)
    if least is None:
        least = np.array([int(c) * budget // whole for c in counts], np.int64)
    best, less = _fitted(lengths, counts, budget, least), 1
    while (lengths * best).sum() < budget and least.any():
        # Twice as many documents of each length are set free each time.
        least = np.maximum(least - less, 0)
        found = _fitted(lengths, counts, budget, least)
        best = max(best, found, key=lambda taken: (lengths * taken).sum())
        less *= 2
    return best


def _fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, least: np.ndarray) -> np.ndarray:
    """``least``, and the documents that bring the sum nearest to the budget from below."""
    chosen = least.copy()
    left = budget - int((lengths * chosen).sum())
    spare = counts - chosen
    # By default, one document of each length at most has been rounded off: longest first while much is left.
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FITTED_WORDS:
            break
        if lengths[i] > 0:
            extra = min(int(spare[i]), max(0, left - FITTED_WORDS // 2) // int(lengths[i]))
            chosen[i] += extra
            spare[i] -= extra
            left -= extra * int(lengths[i])
    # Bounded knapsack: bit s of a row tells whether the sum s can be reached. Counts go in powers
    # of two, so each length costs few steps.
    items = [
        (i, size)
        for i in range(len(lengths))
        if lengths[i] > 0
        for size in _powers(min(int(spare[i]), left // int(lengths[i])))
    ]
    mask = (1 << (left + 1)) - 1
    rows = [1]
    for i, size in items:
        if rows[-1] >> left & 1:
            break
        rows.append(rows[-1] | (rows[-1] << (int(lengths[i]) * size)) & mask)
    reached = rows[-1].bit_length() - 1
    for (i, size), row in zip(reversed(items[: len(rows) - 1]), reversed(rows[:-1]), strict=True):
        if not row >> reached & 1:
            chosen[i] += size
            reached -= int(lengths[i]) * size
    return chosen


def _powers(count: int) -> list[int]:
    """Numbers whose sums are exactly 0 to ``count``."""
    found, size = [], 1
    while count > 0:
        found.append(min(size, count))
        count -= found[-1]
        size *= 2
    return found


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """How often the mix takes each document.

    Returns the key, ``source``, ``text_key`` (a hash of the text), ``size``, ``source_size``,
    ``target`` (of the source) and ``copies``. The sources, in the order of code points with null
    last, have the weights in turn. Targets are found in one task that gets a row a source; the lengths of
    a source (one row each) meet in one task.
    """
    text_key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sized = settle(
        docs.select(
            F.col(key).alias(key),
            F.col(source).alias("source"),
            text_key.alias("text_key"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key), text_key).alias("draw"),
        )
    )
    lengths = settle(
        sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # A row a source, written so that the join's sides are plain exchanges.
    plan = settle(with_targets(sizes, weights))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        words, target = int(frame.source_size.iloc[0]), float(frame.target.iloc[0])
        base = min(MOST_COPIES, int(target // words)) if words else 0
        budget = round(target) - base * words if base < MOST_COPIES else 0
        lengths, counts = frame["size"].to_numpy(), frame.n.to_numpy()
        extra = fit_budget(lengths, counts, budget)
        if (lengths * extra).sum() < budget:
            more = fit_budget(lengths, counts * (MOST_COPIES - base), budget)
            extra = max(extra, more, key=lambda found: (lengths * found).sum())
        if (lengths * extra).sum() < budget:
            # One copy of each document less to begin with leaves more sums to choose from.
            total = budget + base * words
            least = np.maximum(counts * total // words - counts, 0)
            free = fit_budget(lengths, counts * MOST_COPIES, total, least)
            if (lengths * (free - base * counts)).sum() > (lengths * extra).sum():
                base, extra = 0, free
        return pd.DataFrame(
            {
                "source": frame.source,
                "size": frame["size"],
                "source_size": frame.source_size,
                "target": frame.target,
                "n": frame.n,
                "base": base,
                "extra": extra,
            }
        )

    same = lengths.source.eqNullSafe(plan.source)
    fitted = settle(
        lengths.join(plan, same)
        .select(lengths.source, "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            fit,
            "source string, size long, source_size long, target double, n long, base long,"
            " extra long",
        )
    )
    # A length is cut into slices by the draw, of about SLICE_ROWS documents. Whole slices are
    # taken first; within the slice that the number ends in, documents are taken by their draw.
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    slice_of = F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * slices)
    joined = sized.join(
        fitted.withColumnsRenamed({"source": "_source", "size": "_size"}),
        sized.source.eqNullSafe(F.col("_source")) & (sized["size"] == F.col("_size")),
    ).withColumn("slice", F.least(slice_of, slices - 1))
    held = joined.groupBy("_source", "_size", "slice").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("_source", "_size").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    held = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    held = held.withColumnsRenamed({"_source": "hs", "_size": "hz", "slice": "hl"})
    place = Window.partitionBy("_source", "_size", "slice").orderBy("draw", key)
    ranked = joined.withColumn("place", F.row_number().over(place)).join(
        held,
        F.col("_source").eqNullSafe(F.col("hs"))
        & (F.col("_size") == F.col("hz"))
        & (F.col("slice") == F.col("hl")),
    )
    rank = F.col("before") + F.col("place")
    taken = F.expr("extra div n") + (rank <= F.expr("extra % n")).cast("long")
    return ranked.select(
        key,
        "source",
        "text_key",
        "size",
        "source_size",
        "target",
        (F.col("base") + taken).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Repeated rows (same id, text and source) are counted together and one of them is repeated.
    """
    key, text, source = (options.get(n, d) for n, d in (
        ("key", "doc_id"), ("text", "text"), ("source", "source")))
    names = [unused(n, docs.columns) for n in ("of_key", "of_source", "of_text", "copies", "row")]
    of_key, of_source, of_text, copies, row = names
    counted = (
        mix_sources(docs, **options)
        .groupBy(
            F.col(key).alias(of_key), F.col("source").alias(of_source), F.col("text_key").alias(of_text)
        )
        .agg(F.sum("copies").alias(copies))
        .filter(F.col(copies) > 0)
    )
    text_key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    found = docs.join(
        settle(counted),
        docs[key].eqNullSafe(F.col(of_key))
        & docs[source].eqNullSafe(F.col(of_source))
        & (text_key == F.col(of_text)),
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    # Each task keeps one of its own repeated rows first.
    once = found.dropDuplicates([of_key, of_source, of_text]).withColumn(row, repeated)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
