"""Counts of requests over time and requests in flight; the same plans serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.operators.prefix import running


def tumbling(events: DataFrame, size: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Requests per kind and window (ts, kind)."""
    return _late(events, watermark).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    return _late(events, watermark).groupBy(F.window("ts", size, slide), "kind").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Runs of one kind without a longer pause than ``gap``."""
    return _late(events, watermark).groupBy(F.session_window("ts", gap), "kind").agg(F.count("*").alias("n"))


def _late(events: DataFrame, watermark: str | None) -> DataFrame:
    return events if watermark is None else events.withWatermark("ts", watermark)


def outstanding(requests: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Requests in flight after each start and end, ends first at one instant."""
    marks = F.explode(
        F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))
    )
    rows = requests.select(key, marks.alias("m")).select(key, "m.at", "m.step")
    out = running(rows, [], ["at", "step", key], in_flight=("sum", F.col("step")))
    return out.withColumn("in_flight", F.col("in_flight").cast("bigint"))
