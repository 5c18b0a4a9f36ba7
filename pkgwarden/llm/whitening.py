"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum (eigenvalues, eigenvectors) of the scatter matrix of the rows it
has seen. A row is a rank-one update: the row less the running mean, weighted so that the scatter
stays centred. An update is solved in the eigenbasis by the secular equation, after deflation
(entries that vanish, values that coincide); the vectors are computed from the roots, with the
right-hand side that has exactly these roots, so they stay orthogonal. Spectra of partitions are
combined in a tree: the vectors of one, each scaled by the root of its value, and the difference of
the means are successive rank-one updates of the other. A last pass projects the covariance of all
rows, centred by the exact mean, on the basis found (Rayleigh-Ritz), which brings the components to
double precision.

A spectrum has as many numbers as the square of the dimension; nothing else is held by a task or by
the driver, however many rows there are.

Defined results: rows whose vector is null, or holds null, nan or infinite entries, take no part,
neither do those of another length than most, or without entries; rows of one id, or without one, are
rows of their own, and equal rows all count. An entry beyond ``2^40`` after scaling is taken as that. A
direction without variance (fewer rows than dimensions, equal rows) cannot be whitened and gives no
component. Without any rows the result is empty. ``deviation`` is null where it exceeds a long. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgwarden.llm.vectors import complete, matrix, of_one_length, scaled
from pkgwarden.sources.tables import settle

EPS = np.finfo(np.float64).eps
#: Spectra (or sums) combined by one task.
FAN = 16
#: Steps of the root finder; each narrows the bracket, most roots need fewer than ten.
STEPS = 80
#: Share of the largest eigenvalue from which on a direction counts as having variance.
LEAST_SHARE = 1e-12


# ---- rank-one updates ----------------------------------------------------------------------


def _inner_root(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The root of ``c t^2 - a t + b`` that lies between the two poles it was made from."""
    gap = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
    return np.where(a <= 0, (a - gap) / (2 * c), 2 * b / (a + gap))


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of ``diag(d) + rho z z'``.

    ``d`` ascends strictly, no ``z`` is 0 and ``rho`` is positive, so one root of
    ``1 + rho sum(z^2 / (d - t))`` lies between each two poles and one beyond the last. Roots are
    kept as distances from the nearer pole. Each step fits a function of the two neighbouring poles;
    a step that leaves the bracket is replaced by bisection.
    """
    k = len(d)
    z2 = z * z
    if k == 1:
        return d + rho * z2, np.ones((1, 1))
    beyond = np.append(d[1:], d[-1] + rho * z2.sum())
    width = beyond - d
    last = np.arange(k) == k - 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = rho * z2 / ((d[None, :] - d[:, None]) - width[:, None] / 2)
        value = 1 + middle.sum(1)
        near = value >= 0
        origin = np.where(near | last, d, beyond)
        low = np.where(near, 0.0, np.where(last, width / 2, -width / 2))
        high = np.where(near, width / 2, np.where(last, width, 0.0))
        pole, after = d - origin, beyond - origin
        delta = d[None, :] - origin[:, None]
        # First guess: the two neighbouring poles, and the others as they are in the middle.
        s, s_after = rho * z2, np.append(rho * z2[1:], 0.0)
        own = middle[np.arange(k), np.arange(k)]
        rest = value - own - np.append(middle[np.arange(k - 1), np.arange(1, k)], 0.0)
        root = _inner_root(
            rest * (pole + after) + s + s_after, rest * pole * after + s * after + s_after * pole, rest
        )
        root = np.where((root > low) & (root < high), root, (low + high) / 2)
        lower = np.tri(k, dtype=bool)
        for _ in range(STEPS):
            diff = delta - root[:, None]
            term = rho * z2 / diff
            value = 1 + term.sum(1)
            done = np.abs(value) <= 4 * EPS * (1 + np.abs(term).sum(1))
            if done.all():
                break
            low = np.where(value < 0, root, low)
            high = np.where(value >= 0, root, high)
            slope = term / diff
            left = (slope * lower).sum(1)
            right = slope.sum(1) - left
            to, beyond_it = pole - root, after - root
            step = _inner_root(
                (to + beyond_it) * value - to * beyond_it * (left + right),
                to * beyond_it * value,
                value - to * left - beyond_it * right,
            )
            moved = root + step
            inside = (moved > low) & (moved < high)
            moved = np.where(inside, moved, (low + high) / 2)
            settled = done | (moved == root) | (moved == low) | (moved == high)
            root = np.where(settled, root, moved)
            if settled.all():
                break
    diff = (delta - root[:, None]).T  # d_i - root_j
    gaps = d[None, :] - d[:, None]
    np.fill_diagonal(gaps, 1.0)
    weight = np.sqrt(np.abs((-diff / gaps).prod(1))) * np.where(z < 0, -1.0, 1.0)
    vectors = weight[:, None] / diff
    return origin + root, vectors / np.sqrt((vectors * vectors).sum(0))


def rank_one(
    values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float
) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending values, vectors as columns) after ``rho v v'`` has been added."""
    z = vectors.T @ v
    length = float(np.sqrt(z @ z))
    strength = rho * length * length
    if not strength:
        return values, vectors
    z = z / length
    small = 8 * EPS * max(abs(values[0]), abs(values[-1]), strength)
    vectors = vectors.copy()
    # Values that coincide: a reflection moves the whole entry to the last of them.
    apart = np.flatnonzero(np.diff(values) > small) + 1
    if len(apart) < len(values) - 1:
        for start, end in zip([0, *apart], [*apart, len(values)], strict=True):
            if end - start < 2:
                continue
            w = z[start:end].copy()
            norm = float(np.sqrt(w @ w))
            if not norm:
                continue
            target = -norm if w[-1] > 0 else norm
            w[-1] -= target
            own = vectors[:, start:end]
            vectors[:, start:end] = own - np.outer(own @ w, w * (2 / (w @ w)))
            z[start:end] = 0
            z[end - 1] = target
    moving = strength * np.abs(z) > small
    if not moving.any():
        return values, vectors
    new, turn = secular(values[moving], z[moving], strength)
    values = values.copy()
    values[moving] = new
    vectors[:, moving] = vectors[:, moving] @ turn
    if moving.all():
        return values, vectors
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen, their mean, and the spectrum of their scatter matrix about it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, row: np.ndarray) -> None:
        """One more row."""
        off = row - self.mean
        if self.n:
            weight = self.n / (self.n + 1)
            self.values, self.vectors = rank_one(self.values, self.vectors, off, weight)
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """The rows of another spectrum, as its vectors and the difference of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        off = other.mean - self.mean
        n = self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(
                self.values, self.vectors, off, self.n * (other.n / n)
            )
        self.mean = self.mean + off * (other.n / n)
        self.n = n

    def frame(self, part: int) -> pd.DataFrame:
        numbers = np.concatenate(([self.n], self.mean, self.values, self.vectors.ravel()))
        return pd.DataFrame({"part": [part], "numbers": [numbers]})

    @staticmethod
    def read(numbers: np.ndarray, dims: int) -> Spectrum:
        n, mean, values, rest = np.split(np.asarray(numbers), [1, 1 + dims, 1 + 2 * dims])
        return Spectrum(int(n[0]), mean, values, rest.reshape(dims, dims))


# ---- Spark ---------------------------------------------------------------------------------

_STATE = "part long, numbers array<double>"


def _part() -> int:
    return TaskContext.get().partitionId()


def combined(
    parts: DataFrame, count: int, merge: Callable[[list[np.ndarray]], np.ndarray]
) -> np.ndarray | None:
    """The numbers of all partitions merged in a tree; no task gets more than ``FAN`` of them."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        # In the order of the parts, so that a task that is run again merges alike.
        own = frame.sort_values("part")
        return pd.DataFrame({"part": [own.part.iloc[0] // FAN], "numbers": [merge(list(own.numbers))]})

    while count > 1:
        group = F.floor(F.col("part") / FAN).cast("long")
        parts = parts.groupBy(group).applyInPandas(work, _STATE)
        count = -(-count // FAN)
    found = parts.first()
    return None if found is None else np.asarray(found.numbers)


def _over_partitions(
    rows: DataFrame, measure: Callable[[Iterator[np.ndarray]], np.ndarray | None]
) -> DataFrame:
    """One row of numbers for each partition that has rows (column ``x``)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = measure(matrix(frame.x) for frame in batches if len(frame))
        if numbers is not None:
            yield pd.DataFrame({"part": [_part()], "numbers": [numbers]})

    return rows.select("x").mapInPandas(work, _STATE)


def _summed(
    rows: DataFrame, tasks: int, square: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray | None:
    """The sum over all batches of what ``square`` makes of one."""

    def measure(batches: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in batches:
            own = square(x).ravel()
            total = own if total is None else total + own
        return total

    return combined(_over_partitions(rows, measure), tasks, lambda parts: np.sum(parts, axis=0))


@dataclass
class Whitening:
    """A fitted transformation. ``vectors`` has the components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over the dimensions of ``(n x - sum)^2`` for each row."""
        sums = np.array(self.sums, object)
        off = x.astype(object) * self.n - sums
        if float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (off.astype(np.int64) ** 2).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (int(sum(c * c for c in row)) for row in off)]


def fit(rows: DataFrame, dims: int, components: int) -> Whitening | None:
    """The whitening of a written table of rows (``x``, arrays of ``dims`` longs)."""
    tasks = rows.rdd.getNumPartitions()
    sums = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    exact = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums")).first()
    if not exact.n:
        return None

    def update(batches: Iterator[np.ndarray]) -> np.ndarray | None:
        spectrum = Spectrum.empty(dims)
        for x in batches:
            for row in x:
                spectrum.add(row)
        return spectrum.frame(0).numbers[0] if spectrum.n else None

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        first, *others = (Spectrum.read(p, dims) for p in parts)
        for other in others:
            first.join(other)
        return first.frame(0).numbers[0]

    found = Spectrum.read(combined(_over_partitions(rows, update), tasks, merge), dims)
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    sums = [int(s) for s in exact.sums]
    mean = np.array([s / exact.n for s in sums])

    def projected(x: np.ndarray) -> np.ndarray:
        own = (x - mean) @ basis
        return own.T @ own

    inner = _summed(rows, tasks, projected).reshape(dims, dims) / exact.n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(inner))
    kept = int((values > max(LEAST_SHARE * values[0], 0)).sum())
    kept = min(components, kept)
    model = Whitening(
        exact.n, sums, values[:kept], vectors[:, :kept], values[:kept] / trace if trace else values[:0]
    )
    if kept:

        def spread(x: np.ndarray) -> np.ndarray:
            own = model.apply(x)
            return own.T @ own

        covariance = _summed(rows, tasks, spread).reshape(kept, kept) / exact.n
        model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


def whiten(
    vectors: DataFrame,
    components: int = 8,
    factor: int = 1024,
    shift: int = 100_000,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of each row that takes
    part and each component, numbered from 1 by falling eigenvalue.

    The model is fitted at once; its few numbers go to the tasks that transform the rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    whole, dims = of_one_length(own.filter(complete(F.col("vec"))), "vec")
    rows = settle(whole.select("id", scaled("vec", factor, shift).alias("x")))
    model = fit(rows, dims, components) if dims else None
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    shared = spark.sparkContext.broadcast(model)  # a matrix of the dimension and the components

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        kept = len(fitted.values)
        for frame in batches:
            if not len(frame) or not kept:
                continue
            x = matrix(frame.x, np.int64)
            off = pd.Series(fitted.deviations(x), dtype="Int64")
            yield pd.DataFrame(
                {
                    "id": frame.id.repeat(kept).to_numpy(),
                    "component": np.tile(np.arange(1, kept + 1), len(frame)),
                    "n": fitted.n,
                    "deviation": off.repeat(kept).array,
                    "whitened": fitted.apply(x).ravel(),
                    "explained": np.tile(fitted.explained, len(frame)),
                    "identity_error": fitted.identity_error,
                }
            )

    return rows.mapInPandas(work, schema).withColumnRenamed("id", key)
