"""Connected components of a link table by alternating stars; no step holds more than links in any one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import cut

#: Smallest neighbours of up to so many nodes are broadcast (16 bytes each); beyond it the join is by shuffle.
BROADCAST_NODES = 500_000
ROUNDS = 60


def _smallest(edges: DataFrame) -> tuple[DataFrame, int]:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    return least, least.count()


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    return edges.join(F.broadcast(least) if n <= BROADCAST_NODES else least, "u")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links: a and b, long. Gives node and component (smallest node reachable) of every node with a link to another."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = cut(edges)
    seen = _state(edges)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        # Larger neighbours of each node move to its smallest neighbour, then smaller ones do, until stars remain.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, n = _smallest(both)
        large = _joined(both, least, n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut(large)
        least, n = _smallest(large)
        moved = _joined(large, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
