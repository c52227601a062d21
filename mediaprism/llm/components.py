"""Connected components of an edge table, in DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond").  Each
round is an aggregation with map-side minimum and an equi-join against one row a node, so a hub that touches a third of
all edges is pre-aggregated, and its join side can be split by adaptive skew handling.  No edge or label reaches the
driver; only a row count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(pairs: DataFrame, wide: bool) -> DataFrame:
    """One round.  ``pairs`` has a > b.  Large star: each node's larger neighbours go to its minimum; small star: its
    smaller neighbours and itself do."""
    if wide:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        joined = pairs.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is the smallest node that can be reached.

    Order of the two ends, repeated edges and loops don't matter; rows with a null end are ignored.  A node that occurs
    in loops only is no row of the result.  An empty table gives an empty result.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen = mark(pairs)
    if not seen[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        pairs = stored(_star(_star(pairs, True), False), "star")
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
