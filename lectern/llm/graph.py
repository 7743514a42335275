"""Connected components of an edge list, by alternating large-star and small-star rounds.

Every round is two joins and two aggregates with partial sums; no component, neighbour list or edge set ever
reaches the driver or sits in one task. A hub's edges are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, materialise


def _stars(pairs: DataFrame, only_smaller: bool) -> DataFrame:
    """For each node u with neighbours v: (v, m) where m is the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if only_smaller:
        own = least.select(F.col("u").alias("v"), "m")
        return joined.select("v", "m").union(own).filter("v != m").distinct()
    return joined.filter("v > u").select("v", "m").filter("v != m").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of an edge, root being the least node that it reaches.

    Loops, repeated edges and both directions are allowed; null ends are ignored; no edges give no rows.
    """
    at = edges.select(F.col(a).alias("v"), F.col(b).alias("m")).filter("v is not null and m is not null and v != m")
    at = materialise(at.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct(), "edges")
    mark = None
    while True:
        both = at.select(F.col("v").alias("u"), F.col("m").alias("v")).union(at.select(F.col("m").alias("u"), "v"))
        large = materialise(_stars(both, only_smaller=False), "large-star")
        before, at = at, materialise(_stars(large.select(F.col("v").alias("u"), F.col("m").alias("v")), only_smaller=True), "small-star")
        discard(before, large)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = at.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
