"""Requests: several regions or probes per query, precomputed outputs, metadata and tenants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.similarity import ranked, search

DEFAULT_TENANT = "Test"


def explode_regions(lines: DataFrame) -> DataFrame:
    """One row per region of a request line ``file TAB region TAB region ...``."""
    parts = F.split("line", "\t")
    return lines.select(
        "request_id", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    ).select("request_id", (F.col("pos") + 1).cast("bigint").alias("region_no"), F.col("col").alias("region"))


def multi_probe(queries: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Several variants of one query object: the nearest of them counts."""
    probes = queries.select("query_id", F.explode("probes").alias("vec"))
    top_n = how.pop("top_n", None)
    hits = search(probes, items, top_n=top_n, **how)
    best = hits.groupBy("query_id", "item_id").agg(F.min("dist").alias("dist"))
    return best if top_n is None else ranked(best, top_n)


def reuse_outputs(todo: DataFrame, done: DataFrame, key: str,
                  compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take the outputs there are and compute only the missing ones."""
    ready = todo.select(key).join(done, key).withColumn("computed", F.lit(False))
    fresh = compute(todo.join(done, key, "left_anti")).withColumn("computed", F.lit(True))
    return ready.unionByName(fresh)


def attach_metadata(files: DataFrame, meta: DataFrame, key: str = "key") -> DataFrame:
    return files.join(meta, key, "left")


def tenant_of(requests: DataFrame, keys: DataFrame, default: str = DEFAULT_TENANT) -> DataFrame:
    """Access key -> application; an unknown key falls back to the default and is not valid."""
    return (
        requests.join(keys.withColumn("valid", F.lit(True)), "key", "left")
        .withColumn("app", F.coalesce("app", F.lit(default)))
        .withColumn("valid", F.coalesce("valid", F.lit(False)))
    )
