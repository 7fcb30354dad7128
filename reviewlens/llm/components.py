"""Connected components of a distributed edge list (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import staged


def _lowest(edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The smallest ``value`` per ``key``, staged: joined back, both sides are shuffled, so AQE can split a hot key."""
    return staged(edges.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("low")), name)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node with an edge: ``root`` is the smallest node reachable.

    Edges are pairs of longs in any order and number; null ends and loops are ignored. Each
    round points every larger end of an edge to the smallest neighbour of the smaller end,
    then all smaller neighbours of a node to the smallest of them; the edges end as stars
    around the roots after few rounds (O(log^2) of the longest path). Minima are taken with
    partial aggregation, so a hub with any number of edges is not gathered. Each half round
    is written to the shared folder.
    """
    lo, hi = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    e = staged(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
               .select(hi.alias("u"), lo.alias("v")).distinct(), "components")
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == state or now[0] == 0:
            break
        state = now
        # large star: a node's smallest neighbour (or itself), for each larger neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "u", "v", "components-low")
        e = e.join(low, F.col("v") == F.col("k")).select("u", F.least("low", "v").alias("v"))
        e = staged(e.distinct(), "components")
        # small star: all smaller neighbours and the node itself to the smallest
        low = _lowest(e, "u", "v", "components-low")
        near = e.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = near.filter(F.col("u") != F.col("v")).union(low.select(F.col("k").alias("u"), F.col("low").alias("v")))
        e = staged(e.distinct(), "components")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
