"""Distributed union-find: connected components by repeated contraction, DataFrame operations only.

In each round every node points at the smallest of itself and its neighbours, pointers are followed
once more, and the edges are rewritten to the nodes pointed at; edges inside one node vanish.  Nodes
are fingerprints, so their order is random and a round removes a fixed share of them; a star of any
size is gone in two rounds.  The per-node minimum is aggregated before it is shuffled, and each
round is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (its component's representative) for the nodes of edges (a, b); both of one type.

    Loops and repeated edges do no harm; nulls are not allowed; no edges give no rows.
    """
    left = durable(edges.select("a", "b").filter("a <> b").distinct())
    roots = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("r"))
        far = near.select(F.col("v").alias("r"), F.col("r").alias("rr"))
        near = durable(near.join(far, "r", "left").select("v", F.coalesce("rr", "r").alias("r")))
        to_a, to_b = near.select(F.col("v").alias("a"), F.col("r").alias("ra")), near.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        left = durable(left.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        roots = durable(roots.join(near.select(F.col("v").alias("root"), "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root")))
    return roots
