"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of distinct vectors (``FIT_ROWS``, those of the smallest
hash) and has at most ``MAX_LEAVES`` leaves, so it is small enough to broadcast. Every vector is
put into a leaf. A query walks the tree through a priority queue, the node of the largest inner
product of query and centroid first, and visits leaves in that order. How many it visits is
calibrated: visits grow by a quarter until ``RECALL`` of the true neighbours of sampled queries,
found by comparing them with every vector, lie in the leaves visited. Leaves are visited further while they
hold fewer rows than asked for.

Equal vectors are one candidate, with its ``k + 1`` smallest ids (no further one can be among the
``k`` nearest of any query), so copies cannot fill a leaf. Neighbouring
leaves form blocks of bounded size; a query is sent once to each block of which it visits a leaf, and
a block returns the nearest of the leaves visited. A block of many queries, or of a large leaf, is cut by
its own counts. Scores are summed in double precision from the first component to the last.

Vectors that are null, zero, or hold null, nan or infinite components take no part, neither do
those of another length than most. Of several vectors of one id the smallest counts; an id that is
null takes no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.sources.tables import settle

#: Vectors the tree is fitted on, at most.
FIT_ROWS = 20_000
#: Children of a node, vectors of a leaf in the mean, leaves at most.
BRANCHES = 16
LEAF_ROWS = 200
MAX_LEAVES = 4_096
#: Queries that visits are calibrated with, at most, and the share of neighbours to be found.
CALIBRATED = 200
RECALL = 0.95
#: Vectors of a block of leaves, and queries that meet it in one task, at most about.
BLOCK = 16_384
QUERY_BLOCK = 4_096
#: Queries multiplied with a block at a time.
AT_ONCE = 256


# ---- the tree ------------------------------------------------------------------------------


@dataclass
class Node:
    centroid: np.ndarray
    children: list[Node] = field(default_factory=list)
    centroids: np.ndarray | None = None
    leaf: int = -1


def _cluster(rows: np.ndarray, count: int, random: np.random.Generator) -> np.ndarray:
    """Number of the nearest of ``count`` centroids for each row: a few rounds of k-means."""
    centroids = rows[random.choice(len(rows), count, replace=False)]
    nearest = np.zeros(len(rows), np.int64)
    for _ in range(8):
        gap = (centroids * centroids).sum(1)[None, :] - 2 * rows @ centroids.T
        nearest = gap.argmin(1)
        for i in range(count):
            own = rows[nearest == i]
            if len(own):
                centroids[i] = own.mean(0)
    return nearest


class Tree:
    """A fitted tree; leaves are numbered from 0."""

    def __init__(self, rows: np.ndarray, leaves: int, seed: int = 11) -> None:
        self.leaves = 0
        random = np.random.default_rng(seed)
        self.root = self._grow(rows, leaves, random)

    def _grow(self, rows: np.ndarray, leaves: int, random: np.random.Generator) -> Node:
        node = Node(rows.mean(0))
        parts = []
        if leaves > 1 and len(rows) > 1:
            nearest = _cluster(rows, min(BRANCHES, leaves, len(rows)), random)
            parts = [own for i in range(BRANCHES) if len(own := rows[nearest == i])]
        if len(parts) < 2:
            node.leaf = self.leaves
            self.leaves += 1
            return node
        for own in parts:
            share = max(1, round(leaves * len(own) / len(rows)))
            node.children.append(self._grow(own, min(share, leaves - 1), random))
        node.centroids = np.stack([child.centroid for child in node.children])
        return node

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centroids."""
        found = np.zeros(len(rows), np.int64)
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            node, own = waiting.pop()
            if not node.children:
                found[own] = node.leaf
                continue
            centroids = node.centroids
            gap = (centroids * centroids).sum(1)[None, :] - 2 * rows[own] @ centroids.T
            nearest = gap.argmin(1)
            for i, child in enumerate(node.children):
                part = own[nearest == i]
                if len(part):
                    waiting.append((child, part))
        return found

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal."""
        queue = [(0.0, 0, self.root)]
        pushed = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                yield node.leaf
                continue
            for gain, child in zip(node.centroids @ query, node.children, strict=True):
                pushed += 1
                heapq.heappush(queue, (-float(gain), pushed, child))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tables, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def nearest_of(
    queries: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    count: int,
    allowed: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` rows of the largest inner product of each query, ties to the smaller id.

    ``allowed`` tells which rows a query may find. Returns positions of queries, positions of rows
    and exact scores. Rows that a matrix product cannot tell from the last place are all scored
    exactly.
    """
    product = queries @ rows.T
    if allowed is not None:
        product[~allowed] = -np.inf
    keep = np.isfinite(product)
    if len(rows) > count:
        last = np.partition(product, len(rows) - count, axis=1)[:, len(rows) - count]
        scale = np.sqrt((queries**2).sum(1)) * np.sqrt((rows**2).sum(1).max())
        keep &= product >= (last - 1e-9 * scale)[:, None]
    asked, found = np.nonzero(keep)
    scores = exact_scores(queries[asked], rows[found])
    order = np.lexsort((ids[found], -scores, asked))
    asked, found, scores = asked[order], found[order], scores[order]
    first = np.searchsorted(asked, np.arange(len(queries)))
    kept = np.arange(len(asked)) - first[asked] < count
    return asked[kept], found[kept], scores[kept]


# ---- Spark ---------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` (doubles) of the rows that take part, one for each id."""
    own = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    fit = own.filter(
        F.col("id").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    lengths = fit.groupBy(F.size("vec").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), "length").first()
    return fit.filter(F.size("vec") == (most.length if most else 0)).groupBy("id").agg(
        F.min("vec").alias("vec")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.empty((0, 0))


@dataclass
class Index:
    """Distinct vectors in leaves (``first``, ``vec``, ``leaf``), the tree, rows of each leaf."""

    rows: DataFrame
    vectors: DataFrame
    ids: DataFrame
    tree: Tree
    held: np.ndarray

    @property
    def spark(self):
        return self.rows.sparkSession


def build_index(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Fit the tree on a sample and put every vector into a leaf.

    Tables of the index are written to the shared folder. ``k`` bounds the ids kept of one vector.
    """
    rows = settle(usable(vectors, key, vector))
    # The number of equal rows kept is bounded before the shuffle and again after it.
    place = Window.partitionBy("vec").orderBy("id")
    ids = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    firsts = rows.groupBy("vec").agg(F.min("id").alias("first"))
    ids = settle(ids.join(firsts, "vec").select("first", "id"))
    firsts = settle(firsts)
    sample = firsts.orderBy(F.xxhash64("vec"), "first").limit(FIT_ROWS).select("vec").toPandas()
    count = firsts.count()
    leaves = min(MAX_LEAVES, max(1, -(-count // LEAF_ROWS)))
    fitted = _matrix(sample.vec)
    tree = Tree(fitted if len(fitted) else np.zeros((1, 1)), leaves)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf(T.LongType())
    def leaf(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf_of(_matrix(column)))

    stored = settle(firsts.withColumn("leaf", leaf("vec")))
    held = np.zeros(tree.leaves, np.int64)
    for row in stored.groupBy("leaf").count().collect():  # a row for each leaf
        held[row.leaf] = row["count"]
    return Index(rows, stored, ids, tree, held)


def true_neighbours(index: Index, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """``query``, ``first``, ``leaf``: nearest distinct vectors of few queries, by comparing them
    with every vector; each task hands on the nearest it has seen."""
    asked, names = _matrix(queries.vec), queries["first"].to_numpy()
    shared = index.spark.sparkContext.broadcast((asked, names))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, names = shared.value
        for frame in batches:
            if len(frame):
                firsts = frame["first"].to_numpy()
                q, r, s = nearest_of(asked, _matrix(frame.vec), firsts, k + 1)
                yield pd.DataFrame(
                    {
                        "query": names[q],
                        "first": firsts[r],
                        "leaf": frame.leaf.to_numpy()[r],
                        "score": s,
                    }
                )

    found = index.vectors.mapInPandas(work, "query long, first long, leaf long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    found = found.filter(F.col("query") != F.col("first"))
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return ranked.select("query", "first", "leaf").toPandas()


def calibrate(index: Index, k: int, recall: float = RECALL) -> int:
    """Leaves to visit: more and more, until the sampled queries find ``recall`` of their
    neighbours."""
    queries = (
        index.vectors.orderBy(F.xxhash64("vec", F.lit(1)), "first").limit(CALIBRATED).toPandas()
    )
    if not len(queries):
        return 1
    truth = true_neighbours(index, queries.reset_index(drop=True), k)
    if not len(truth):
        return 1
    places = {
        first: {leaf: i for i, leaf in enumerate(index.tree.best_first(np.asarray(vec)))}
        for first, vec in zip(queries["first"], queries.vec, strict=True)
    }
    needed = np.array(
        [places[q][leaf] + 1 for q, leaf in zip(truth["query"], truth.leaf, strict=True)]
    )
    visits = 1
    while visits < index.tree.leaves and (needed <= visits).mean() < recall:
        visits = visits + max(1, visits // 4)
    return min(visits, index.tree.leaves)


def search(index: Index, queries: DataFrame, k: int, visits: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of each query id of the index.

    ``queries`` has the ids as ``id``; a query is not its own neighbour.
    """
    visits = visits or calibrate(index, k)
    spark = index.spark
    shared = spark.sparkContext.broadcast((index.tree, index.held))
    asked = queries.select("id").distinct().join(index.rows, "id")
    asked = settle(
        asked.join(index.vectors.select("vec", "first"), "vec").select(
            F.col("id").alias("query_id"), "first", "vec"
        )
    )

    # Leaves of a branch have neighbouring numbers, so blocks of them are visited together.
    blocks = (np.cumsum(index.held) - index.held) // BLOCK
    touched = T.ArrayType(
        T.StructType(
            [
                T.StructField("block", T.LongType()),
                T.StructField("leaves", T.ArrayType(T.LongType())),
            ]
        )
    )

    @F.pandas_udf(touched)
    def probe(column: pd.Series) -> pd.Series:
        tree, held = shared.value
        found = []
        for vec in column:
            visited: dict[int, list[int]] = {}
            rows = 0
            for at, leaf in enumerate(tree.best_first(np.asarray(vec))):
                if at >= visits and rows > k:
                    break
                visited.setdefault(int(blocks[leaf]), []).append(leaf)
                rows += held[leaf]
            found.append([{"block": b, "leaves": own} for b, own in visited.items()])
        return pd.Series(found, dtype=object)

    distinct = asked.groupBy("first").agg(F.min("vec").alias("vec"))
    probes = settle(
        distinct.select("first", "vec", F.explode(probe("vec")).alias("probe")).select(
            "probe.block", "probe.leaves", "first", "vec"
        )
    )
    block_table = spark.createDataFrame(
        [(i, int(b)) for i, b in enumerate(blocks)], "leaf long, block long"
    )
    placed = index.vectors.join(F.broadcast(block_table), "leaf")  # a row for each leaf
    # Each block is cut by its own counts (a row a block); one that no query visits is left out.
    asking = probes.groupBy("block").agg(F.count(F.lit(1)).alias("asking"))
    holding = placed.groupBy("block").agg(F.count(F.lit(1)).alias("holding"))
    cuts = settle(
        asking.join(holding, "block").select(
            "block",
            F.ceil(F.col("asking") / QUERY_BLOCK).alias("q_cuts"),
            F.ceil(F.col("holding") / BLOCK).alias("v_cuts"),
        )
    )

    def own_cut(count: str) -> Column:
        return F.pmod(F.xxhash64("first"), F.col(count)).cast("long")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = (
        probes.join(cuts, "block")
        .withColumn("q", own_cut("q_cuts"))
        .withColumn("v", every("v_cuts"))
        .drop("q_cuts", "v_cuts")
    )
    right = (
        placed.select("block", "leaf", "first", "vec")
        .join(cuts, "block")
        .withColumn("v", own_cut("v_cuts"))
        .withColumn("q", every("q_cuts"))
        .drop("q_cuts", "v_cuts")
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": [], "first": [], "score": []})]
        if len(a) and len(b):
            rows, firsts = _matrix(b.vec), b["first"].to_numpy()
            names, own = np.unique(b.leaf.to_numpy(), return_inverse=True)
            for at in range(0, len(a), AT_ONCE):
                part = a.iloc[at : at + AT_ONCE]
                visited = np.stack([np.isin(names, leaves) for leaves in part.leaves])
                q, r, s = nearest_of(_matrix(part.vec), rows, firsts, k + 1, visited[:, own])
                asked = part["first"].to_numpy()[q]
                found.append(pd.DataFrame({"query": asked, "first": firsts[r], "score": s}))
        return pd.concat(found)

    keys = ["block", "q", "v"]
    met = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(meet, "query long, first long, score double")
    )
    by_vector = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    nearest = met.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = nearest.join(index.ids, "first").withColumn("place", F.row_number().over(by_row))
    found = F.array_sort(F.collect_list(F.struct("place", "id", "score")))
    lists = rows.filter(F.col("place") <= k + 1).groupBy("query").agg(found.alias("found"))
    own = asked.select("query_id", F.col("first").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
