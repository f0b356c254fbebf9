"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect a node's neighbours (larger ones, or smaller ones and itself) to its minimum."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.filter("b > a" if large else "b < a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b); component = smallest node."""
    at = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        at = cut(_star(_star(at, True), False))
        now = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
