"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the smallest node reachable.

    Each round is two group-and-join steps whose result goes to the shared folder in place of the last one. Minima are pre-aggregated, and a
    node with very many edges is split by Spark's skew join. Self-loops, nulls and repeated edges change nothing.
    """
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    state = staged(edges.where("u <> v").select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        turned = _large_star(state).where("u <> v").distinct()
        last, state = state, staged(_small_star(turned).where("u <> v").distinct(), "edges")
        dropped(last)
    else:
        raise RuntimeError(f"the components aren't settled after {max_rounds} rounds")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
