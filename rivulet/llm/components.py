"""Connected components of a graph held as a table of edges.

Contraction: each round every node points at its smallest neighbour (or
itself), the pointers are followed to their roots by doubling, the edges are
renamed to the roots, and loops and repeats go.  A root absorbs at least one
neighbour, so a round at least halves the nodes that still have edges, and
doubling takes logarithmically many joins.  All state is written to the shared
checkpoint folder; nothing is collected but the question whether rows remain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import store


def _roots(parents: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, parent)`` with parent <= node -> ``(node, parent)`` with the
    parent its own parent."""
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = store(parents.join(up, "parent").select("node", "parent", "grand"), "roots")
        parents = jumped.select("node", F.col("grand").alias("parent"))
        if jumped.where("parent <> grand").isEmpty():
            return parents
    raise RuntimeError("pointers did not converge")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: for every node with an edge the
    smallest id it can reach.  Loops and repeated edges are allowed; an empty
    table gives no rows."""
    current = store(edges.select("a", "b").where("a <> b"), "edges")
    assigned = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _roots(store(both.groupBy("a").agg(F.min("b").alias("low"))
                               .select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents"),
                         max_rounds)
        if assigned is None:
            assigned = parents.select(F.col("node").alias("id"), F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            assigned = store(assigned.join(up, "component", "left")
                             .select("id", F.coalesce("parent", "component").alias("component")), "labels")
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        current = store(current.join(of_a, "a").join(of_b, "b").where("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if current.isEmpty():
            return assigned
    raise RuntimeError("components did not converge")
