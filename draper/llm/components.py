"""Connected components of a graph given by its edges, by alternating star contraction.

Edges and labels stay distributed; each round writes its edges to the shared folder,
and the last-but-one is deleted. A large star links every larger neighbour of a node to
the smallest one, a small star links the node and its smaller neighbours to it; minima
are partial aggregates, so a hub's edges never meet in one task before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
    joined = both.join(least, both["a"] == least["hub"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node with an edge can reach."""
    now = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges0")
    sign = None
    for n in range(1, most_rounds + 1):
        now = scratch.table(_star(_star(now, True), False), f"edges{n}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(f"edges{n - 1}")
        if new == sign or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        sign = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
