"""Counts, histograms and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.scalars import rounded


def group_sizes(items: DataFrame, key: str = "label") -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias("n"))


def max_k(rows: DataFrame, set_key: str) -> DataFrame:
    """Smallest set size: the upper limit of k for a multi-vector search."""
    return rows.groupBy(set_key).count().agg(F.min("count").alias("max_k"))


def mean_vector(items: DataFrame, key: str) -> DataFrame:
    """Column-wise mean per key as rows (key, pos, mean)."""
    return (
        items.select(key, F.posexplode("vec"))
        .groupBy(key, "pos")
        .agg(rounded(F.avg("col")).alias("mean"))
    )


def histogram(values: DataFrame, bin_col: str = "bin") -> DataFrame:
    """Counts and shares per bin with the mean, deviation and sum of the whole."""
    bins = values.groupBy(bin_col).agg(F.count("*").alias("n"))
    b, n = F.col(bin_col), F.col("n")
    # The moments come from the bins, not from a second pass over the rows.
    count, total, squares = bins.agg(F.sum(n), F.sum(b * n), F.sum(b.cast("double") * b * n)).first()
    mean = (total or 0) / (count or 1)
    std = max((squares or 0.0) / (count or 1) - mean * mean, 0.0) ** 0.5
    return bins.select(
        bin_col,
        "n",
        rounded(n / F.lit(count)).alias("share"),
        rounded(F.lit(mean)).alias("mean"),
        rounded(F.lit(std)).alias("std"),
        F.lit(total).cast("bigint").alias("total"),
    )


def cell_histogram(rows: DataFrame, item: str, cell: Column, bin_: Column, cells: int, bins: int) -> DataFrame:
    """Normalised value histogram per cell of an item, concatenated in cell order."""
    counted = rows.groupBy(F.col(item), cell.alias("cell"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    filled = counted.groupBy(item).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("cell") * bins + F.col("bin")).alias("k"), F.col("n")))).alias("m")
    )  # at most cells * bins entries
    every_bin = F.sequence(F.lit(0), F.lit(bins - 1))
    in_cell = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda c: F.transform(every_bin, lambda b: F.coalesce(F.try_element_at("m", c * bins + b), F.lit(0).cast("bigint"))),
    )
    summed = F.transform(in_cell, lambda ns: F.struct(
        ns.alias("ns"), F.greatest(F.aggregate(ns, F.lit(0).cast("bigint"), lambda acc, n: acc + n), F.lit(1).cast("bigint")).alias("total")))
    vec = F.flatten(F.transform(summed, lambda c: F.transform(c["ns"], lambda n: n / c["total"])))
    return filled.select(item, vec.alias("vec"))


def time_hist(log: DataFrame, label: str, took: str) -> DataFrame:
    return log.groupBy(label).agg(
        F.count("*").alias("n"), rounded(F.sum(took)).alias("total"), rounded(F.avg(took), 9).alias("mean")
    )


def timing_rollup(log: DataFrame, request: str, tick: str, transport: str) -> DataFrame:
    """Microseconds from a request's first to its last tick, and its mean transport time."""
    return log.groupBy(request).agg(
        F.timestamp_diff("MICROSECOND", F.min(tick), F.max(tick)).alias("span"), rounded(F.avg(transport), 9).alias("transport")
    )


def distinct_errors(log: DataFrame, request: str, error: Column) -> DataFrame:
    """Distinct error texts per request in one line, SUCCESS when there are none."""
    once = log.select(request, error.alias("e")).distinct()
    texts = F.array_join(F.array_sort(F.collect_list("e")), "; ")
    return once.groupBy(request).agg(F.coalesce(F.nullif(texts, F.lit("")), F.lit("SUCCESS")).alias("result"))


def compare_timings(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Speed-up and relative difference of two runs' totals per label."""
    x = a.select(label, F.col("total").alias("a"))
    y = b.select(label, F.col("total").alias("b"))
    return x.join(y, label).select(
        label,
        rounded(F.col("a") / F.col("b")).alias("speed_up"),
        rounded(F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b")).alias("rel_diff"),
    )
