"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgwarden.sources.tables import settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row for each linked node: ``node`` and ``label``, a node of its component.

    In a round, each node moves to the neighbour (or itself) that comes first in an order drawn
    anew for the round, and links are carried over to the nodes moved to. A constant share of nodes
    is expected to vanish in each round, whatever the shape of the components. Tables of a round
    are written to the shared folder, which cuts the lineage. Minima are taken within tasks before
    the shuffle, so a node with many links costs one row a task.
    """
    pair = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    links = settle(links.filter(F.col(a) != F.col(b)).select(*pair).distinct())
    labels = None
    step = 0
    while not links.isEmpty():
        order = [F.xxhash64(F.col(c), F.lit(step)) for c in ("node", "other")]
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        first = F.least(
            F.struct(order[0].alias("rank"), F.col("node").alias("to")),
            F.struct(order[1].alias("rank"), F.col("other").alias("to")),
        )
        moves = settle(ends.groupBy("node").agg(F.min(first)["to"].alias("to")))
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            further = moves.withColumnsRenamed({"node": "label", "to": "next"})
            labels = settle(
                labels.join(further, "label", "left").select(
                    "node", F.coalesce("next", "label").alias("label")
                )
            )
        moved = (
            links.join(moves.withColumnsRenamed({"node": "a", "to": "to_a"}), "a")
            .join(moves.withColumnsRenamed({"node": "b", "to": "to_b"}), "b")
            .filter("to_a <> to_b")
        )
        pair = F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
        links = settle(moved.select(*pair).distinct())
        step += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
