"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the buckets of its n-grams (present or not). Each feature is scaled by the
log ratio of its smoothed frequency in toxic and in clean training texts; a logistic regression is
fitted on the scaled features. The score is the logistic probability.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``, those of the smallest id
hash); scoring covers every whole text. A null or empty text has no features: its score is that of
the intercept. Labels that are null are left out; of several labels of one id each counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.codes import code_points

#: n-grams are taken from words set apart by one space, so that a word looks alike anywhere.
WORDS = re.compile(r"[^\W_]+")
#: n-gram lengths and buckets.
LENGTHS = (4, 6)
BUCKET_BITS = 18
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 6_000
#: Weight of a toxic text against a clean one: toxic texts are few.
TOXIC_WEIGHT = 5.0
#: Rows that the fit works on at a time.
PART_ROWS = 500
#: Smoothing of the counts, rounds and step of the fit, weight of the squared penalty.
SMOOTHING = 1.0
#: Buckets of fewer training texts have no weight.
LEAST_TEXTS = 4
ROUNDS = 50
PENALTY = 1e-2


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's n-grams, ascending. ``flags``: a cleared array of bools."""
    codes = code_points(" ".join(["", *WORDS.findall((text or "").lower()), ""]))
    for length in LENGTHS:
        if len(codes) < length:
            continue
        hashes = np.full(len(codes) - length + 1, length, np.uint32)
        for i in range(length):
            hashes *= np.uint32(0x01000193)
            hashes ^= codes[i : len(codes) - length + 1 + i]
        hashes *= np.uint32(0x9E3779B1)
        flags[hashes >> np.uint32(32 - BUCKET_BITS)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weight of each bucket (ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, buckets: np.ndarray) -> float:
        margin = float(self.weights[buckets].sum(dtype=np.float64)) + self.intercept
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of feature rows and their labels (0 or 1).

    Without both labels it is constant: toxic if there are toxic labels only, clean otherwise.
    """
    size = 1 << BUCKET_BITS
    labels = np.asarray(labels, np.float64)
    positive = float(labels.sum())
    prior = np.log((TOXIC_WEIGHT * positive + 0.5) / (len(labels) - positive + 1.5))
    if positive in (0.0, float(len(labels))):
        return Model(np.zeros(size), float(prior))
    # Rows are worked on in parts, so that little more than the features is in memory.
    parts = [slice(at, at + PART_ROWS) for at in range(0, len(rows), PART_ROWS)]

    def counts(weights: np.ndarray) -> np.ndarray:
        """Sum of the rows' weights for each bucket."""
        total = np.zeros(size)
        for part in parts:
            own = rows[part]
            spread = np.repeat(weights[part], [len(r) for r in own])
            total += np.bincount(np.concatenate(own), spread, size)
        return total

    toxic, clean = counts(labels), counts(1 - labels)
    common = toxic + clean >= LEAST_TEXTS
    rows = [r[common[r]] for r in rows]
    toxic, clean = SMOOTHING + toxic * common, SMOOTHING + clean * common
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    ratio[~common] = 0
    weights = np.where(labels == 1, TOXIC_WEIGHT, 1.0)
    weights /= weights.sum()
    coefficients, intercept = np.zeros(size), float(prior)
    squares, squares_b = np.full(size, 1e-8), 1e-8
    for _ in range(ROUNDS):
        own = ratio * coefficients
        margin = np.array([own[r].sum() for r in rows]) + intercept
        error = weights * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels)
        gradient = ratio * counts(error) + PENALTY * coefficients
        squares += gradient * gradient
        coefficients -= 0.1 * gradient / np.sqrt(squares)
        slope = float(error.sum())
        squares_b += slope * slope
        intercept -= 0.1 * slope / np.sqrt(squares_b)
    return Model(ratio * coefficients, intercept)


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    flags = np.zeros(1 << BUCKET_BITS, bool)
    return pd.Series([features(t, flags).tobytes() for t in texts], dtype=object)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    key: str = "doc_id",
    text: str = "text",
    max_rows: int = FIT_ROWS,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows: those whose id has the smallest hash.

    Only the ids of the sample (bounded) are broadcast. Its features (buckets, bounded by
    ``max_rows`` times the number of buckets) meet in one task, which hands the model to the driver.
    """
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_rows)
    )
    sample = (
        docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_label", _features("_text").alias("_buckets"))
    )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [pair for b in batches for pair in zip(b["_label"], b["_buckets"], strict=True)]
        # In a fixed order, so that sums do not depend on the order of the rows.
        found.sort(key=lambda pair: (pair[0], hashlib.sha256(pair[1]).digest()))
        rows = [np.frombuffer(pair[1], np.int32) for pair in found]
        model = fit(rows, np.array([pair[0] for pair in found], np.float64))
        weights = model.weights.astype(np.float64).tobytes()
        yield pd.DataFrame({"weights": [weights], "intercept": [model.intercept]})

    learnt = sample.repartition(1).mapInPandas(learn, "weights binary, intercept double").first()
    if learnt is None:
        return fit([], np.empty(0))
    return Model(np.frombuffer(learnt.weights, np.float64), learnt.intercept)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column function over the whole text; the model is broadcast (one number a bucket)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        flags = np.zeros(1 << BUCKET_BITS, bool)
        return pd.Series([own.score(features(t, flags)) for t in texts], dtype=float)

    return scored(F.col(text))


def keep_clean(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5
) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with."""
    model = train(docs, labels, label)
    return docs.filter(score(docs, model) < threshold)
