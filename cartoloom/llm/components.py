"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node that isn't the least of its component; label is that least node.

    edges: ``a, b``.  Each round hooks every node to its least smaller neighbour, shortens the chains by doubling and
    contracts the edges, so rounds grow with the logarithm of the longest chain.  Nothing is gathered by node.
    """
    lo, hi = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    rest = settled(edges.where("a <> b").select(hi, lo).distinct())
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        # settled first: a join of plain shuffles can be split where a hub is hot
        hook = settled(rest.groupBy("u").agg(F.min("v").alias("p")))
        for _ in range(2):
            to = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = hook.join(to, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        hook = settled(hook)
        rounds.append(hook)
        to = hook.select(F.col("u").alias("v"), F.col("p").alias("q"))
        moved = rest.join(hook, "u").join(to, "v", "left").select(F.col("p").alias("a"), F.coalesce("q", "v").alias("b"))
        rest = settled(moved.where("a <> b").select(hi, lo).distinct())
    if not rounds:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("label"))
    known = rounds[-1].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for hook in reversed(rounds[:-1]):
        to = known.select(F.col("node").alias("p"), "label")
        known = known.unionByName(hook.join(to, "p", "left").select(F.col("u").alias("node"), F.coalesce("label", "p").alias("label")))
        known = settled(known)
    return known
