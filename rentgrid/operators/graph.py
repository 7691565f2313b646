"""Connected components by alternating large-star and small-star rounds.

A node's edges are aggregated before every shuffle and nothing is collected; each round is written
to the shared checkpoint folder.  O(log^2 n) rounds suffice, whatever the shape of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.operators.lineage import cut

MAX_ROUNDS = 60
#: A node with more than this share of the edges is a hub; there are fewer than 2 / HUB of them.  Fewer edges than PLAIN are
#: joined without a look at hubs.
HUB, PLAIN = 1 / 50_000, 1_000_000


def _is_forest(e: DataFrame) -> bool:
    """Each child has one parent, and no parent is a child."""
    child = e.groupBy("u").agg(F.count("*").alias("n"))
    bad = child.where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(child, "u", "left_semi"))
    return not bad.head(1)


def _beside(edges: DataFrame, lowest: DataFrame, n: int) -> DataFrame:
    """Edges with ``m`` of their ``u``: hubs' by broadcast, so that none of their edges meet in one task; the rest by key.

    lowest: (u, m, k), k the number of edges of u among ``n``."""
    if n <= PLAIN:
        return edges.join(lowest.select("u", "m"), "u")
    limit = max(1, int(n * HUB))
    hubs = lowest.where(F.col("k") > limit).select("u", "m")
    met = edges.join(F.broadcast(hubs), "u", "left")
    rest = met.where("m is null").drop("m").join(lowest.where(F.col("k") <= limit).select("u", "m"), "u")
    return met.where("m is not null").unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge."""
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _is_forest(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        n = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("k"))
        large = _beside(both.where("v > u"), lowest, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = _beside(large, lowest, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
