"""Ranked-list algebra on rows (query_id, item_id, dist)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import scalars
from simloom.operators.prefix import numbered
from simloom.operators.similarity import ranked
from simloom.session import cut


def trim(hits: DataFrame, t: float, skip_zero: bool = False) -> DataFrame:
    """Apply a threshold to ranked lists: <0 all, 0 exact, (0,1) radius, N top-N, N.d both."""
    rows = hits.drop("rank")
    if skip_zero:
        rows = rows.filter(F.col("dist") > 0)
    if t == 0:
        return ranked(rows.filter(F.col("dist") == 0))
    top_n, max_dist = scalars.split_threshold(t)
    if max_dist is not None:
        rows = rows.filter(F.col("dist") <= max_dist)
    return ranked(rows, top_n)


def trim_each(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``trim`` with the queries' own (top_n, max_dist) columns, NULL meaning no bound."""
    met = ranked(hits.drop("rank")).join(queries.select("query_id", "top_n", "max_dist"), "query_id")
    return met.filter(
        (F.col("top_n").isNull() | (F.col("rank") <= F.col("top_n")))
        & (F.col("max_dist").isNull() | (F.col("dist") <= F.col("max_dist")))
    ).drop("top_n", "max_dist")


def best(hits: DataFrame) -> DataFrame:
    """Nearest item per query."""
    top = F.min(F.struct("dist", "item_id")).alias("b")
    return hits.groupBy("query_id").agg(top).select(
        "query_id", F.col("b.item_id").alias("item_id"), F.col("b.dist").alias("dist")
    )


def one_score_per_id(hits: DataFrame, lowest: bool = True) -> DataFrame:
    pick = F.min if lowest else F.max
    return hits.groupBy("query_id", "item_id").agg(pick("dist").alias("dist"))


def merge_top_k(parts: DataFrame, k: int | None, key: str = "item_id") -> DataFrame:
    """Merge ranked lists of several partitions: best row per (query, key), then the limit.

    The per-key minimum and the rank bound are both applied before the shuffle as well.
    """
    once = parts.groupBy("query_id", key).agg(F.min("dist").alias("dist"))
    if k is None:
        return numbered(cut(once), ["query_id"], ["dist", key], "rank")
    w = Window.partitionBy("query_id").orderBy("dist", key)
    return once.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def top_k_with_total(hits: DataFrame, k: int) -> DataFrame:
    """k rows per query next to the number of distinct hits."""
    once = one_score_per_id(hits)
    totals = once.groupBy("query_id").agg(F.count("*").alias("total"))
    return ranked(once, k).join(totals, "query_id")


def group_nearest(hits: DataFrame) -> DataFrame:
    """One row per (query, label): its nearest hit, ranked by that distance."""
    near = hits.groupBy("query_id", "label").agg(F.min(F.struct("dist", "item_id")).alias("b"))
    rows = near.select(
        "query_id", "label", F.col("b.item_id").alias("item_id"), F.col("b.dist").alias("dist")
    )
    return ranked(rows)


def group_median(hits: DataFrame) -> DataFrame:
    """One row per (query, label): its upper-median hit."""
    hits = cut(hits)
    rows = numbered(hits, ["query_id", "label"], ["dist", "item_id"], "_n")
    sizes = hits.groupBy("query_id", "label").agg(F.count("*").alias("_t"))
    return (
        rows.join(sizes, ["query_id", "label"])
        .filter(F.col("_n") == F.floor(F.col("_t") / 2) + 1)
        .select("query_id", "label", "item_id", "dist")
    )
