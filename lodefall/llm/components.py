"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import bounded, cut

#: Rounds after which a graph counts as broken; each round at least halves the depth of its trees.
ROUNDS = 60


def least(edges: DataFrame) -> DataFrame:
    """u and its least neighbour; written out, so that the join on it deals both sides anew and can be split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) for every node of `edges` (columns a, b of one orderable type).

    Loops and repeated edges don't matter; nodes without an edge aren't listed. Nothing is collected: a round is two
    aggregations that combine before their shuffle and two joins on what they leave.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = bounded(least(both))
        wide = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        wide = cut(wide.distinct())
        near = bounded(least(wide))
        deep = wide.join(near, "u")
        now = cut(deep.select("u", F.col("m").alias("v")).unionByName(deep.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
