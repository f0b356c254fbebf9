"""Running aggregates that do not put one key's rows on one task.

Rows are range-partitioned by (keys, order); each partition works on its own share of a key and the
shares are then chained through a table of one row per (partition, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.session import cut

HOT_ROWS = 1_000_000

_JOIN = {"count": F.sum, "sum": F.sum, "max": F.max}


def running(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS,
            **aggs: tuple[str, Column | None]) -> DataFrame:
    """Add inclusive running aggregates: ``name=(how, column)`` with how in count, sum, max.

    ``order`` should be total within a key, or rows that tie are numbered arbitrarily. While no key
    holds more than ``hot_rows`` rows, a plain window does it with one shuffle.
    """
    values = {name: (how, f"_v_{name}") for name, (how, _) in aggs.items()}
    ready = df
    for name, (how, column) in aggs.items():
        ready = ready.withColumn(f"_v_{name}", F.lit(1) if how == "count" else column)
    if keys and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        for name, (how, v) in values.items():
            ready = ready.withColumn(name, _JOIN[how](v).over(w))
        return ready.select(*df.columns, *values)
    spread = cut(
        ready.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    at = ["_part", *keys]
    so_far = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = spread.groupBy(*at).agg(
        *[_JOIN[how](v).alias(f"_s_{name}") for name, (how, v) in values.items()]
    )
    offsets = shares.select(
        *at, *[_JOIN[how](f"_s_{name}").over(before).alias(f"_o_{name}") for name, (how, _) in values.items()]
    )
    out = spread
    for name, (how, v) in values.items():
        out = out.withColumn(f"_l_{name}", _JOIN[how](v).over(so_far))
    renamed = offsets
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
    renamed = renamed.withColumnRenamed("_part", "_k_part")
    met = out.join(
        renamed,
        (F.col("_part") == F.col("_k_part"))
        & F.expr(" AND ".join(f"`{k}` <=> `_k_{k}`" for k in keys) or "true"),
    )
    for name, (how, _) in values.items():
        local, offset = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        both = F.greatest(local, offset) if how == "max" else local + F.coalesce(offset, F.lit(0))
        met = met.withColumn(name, both)
    return met.select(*df.columns, *values)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number within ``keys``."""
    out = running(df, keys, order, hot_rows, **{name: ("count", None)})
    return out.withColumn(name, F.col(name).cast("bigint"))
