"""Facet buckets: routing of items and queries, overflow, penalties and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.scalars import penalise, rounded
from simloom.operators.prefix import numbered

UNKNOWN = "Unknown"
SUB_BUCKET_ROWS = 4000

# Bands of the numeric facet; a value in [16, 20] belongs to both neighbours.
BANDS = (("low", 0.0, 20.0), ("high", 16.0, None))


def numeric_facet(value: Column, bands=BANDS) -> Column:
    """Band names a value belongs to; below zero or absent is unknown."""
    inside = [
        F.when((value >= lo) & (F.lit(True) if hi is None else value <= hi), F.lit(name))
        for name, lo, hi in bands
    ]
    known = F.filter(F.array(*inside), lambda n: n.isNotNull())
    return F.when(value.isNull() | (F.size(known) == 0), F.array(F.lit(UNKNOWN))).otherwise(known)


def route_items(items: DataFrame, facet_a: Column, value: Column, bands=BANDS) -> DataFrame:
    """Items with their bucket(s); one in the overlap of two bands goes to both."""
    return items.withColumn("facet_a", F.coalesce(facet_a, F.lit(UNKNOWN))).withColumn(
        "facet_b", F.explode(numeric_facet(value, bands))
    )


def route_queries(queries: DataFrame, facet_a: Column, value: Column, all_a: list[str], bands=BANDS
                  ) -> DataFrame:
    """Buckets each query reads: a known facet and Unknown; an unknown facet reads all.

    ``penalty`` marks buckets whose hits count at sqrt(dist), set only when the numeric facet is
    known: a known facet A penalises Unknown.Unknown, an unknown one every a.Unknown.
    """
    a = F.coalesce(facet_a, F.lit(UNKNOWN))
    b = numeric_facet(value, bands)
    all_b = F.array(*[F.lit(n) for n, _, _ in bands], F.lit(UNKNOWN))
    every_a = F.array(*map(F.lit, all_a), F.lit(UNKNOWN))
    a_known, b_known = a != UNKNOWN, b[0] != UNKNOWN
    read_a = F.when(a_known, F.array(a, F.lit(UNKNOWN))).otherwise(every_a)
    read_b = F.when(b_known, F.concat(b, F.array(F.lit(UNKNOWN)))).otherwise(all_b)
    routed = queries.withColumn("_ak", a_known).withColumn("_bk", b_known).withColumn(
        "facet_a", F.explode(read_a)
    ).withColumn("facet_b", F.explode(read_b))
    a_weak = (F.col("facet_a") == UNKNOWN) | ~F.col("_ak")
    flag = F.col("_bk") & (F.col("facet_b") == UNKNOWN) & a_weak
    return routed.withColumn("penalty", flag).drop("_ak", "_bk")


def buckets_of(queries: DataFrame, present: DataFrame) -> DataFrame:
    """Routes restricted to buckets that exist."""
    return queries.join(present.select("facet_a", "facet_b").distinct(), ["facet_a", "facet_b"], "left_semi")


def apply_penalty(hits: DataFrame) -> DataFrame:
    return hits.withColumn("dist", rounded(penalise(F.col("dist"), F.col("penalty")))).drop("penalty")


def overflow(items: DataFrame, keys: list[str], order: list[str], limit: int = SUB_BUCKET_ROWS) -> DataFrame:
    """Numbered sub-buckets of at most ``limit`` rows, filled in arrival order."""
    return numbered(items, keys, order, "_n").withColumn(
        "overflow_no", F.floor((F.col("_n") - 1) / limit) + 1
    ).drop("_n")


def overflow_names(buckets: DataFrame) -> DataFrame:
    """bucket.1 ... bucket.n of each (bucket, n)."""
    return buckets.select(
        "bucket", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i")
    ).select("bucket", F.concat_ws(".", "bucket", F.col("i").cast("string")).alias("name"))


def overflow_level(name: Column) -> Column:
    """Level of a bucket name, its last part."""
    return F.substring_index(name, ".", -1).try_cast("bigint")


def annotated_facet(facet: Column, annotation: Column) -> Column:
    """An annotation speaks only where the facet is unknown."""
    return F.coalesce(F.nullif(facet, F.lit(UNKNOWN)), annotation, F.lit(UNKNOWN))


CACHE_KEY = ["app", "event_id", "bucket", "request"]


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested buckets with their cached hits; NULL where the bucket still has to be read."""
    return wanted.join(cache, CACHE_KEY, "left")


def cache_store(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """New hits replace those of the same key."""
    return cache.join(fresh.select(*CACHE_KEY), CACHE_KEY, "left_anti").unionByName(fresh)


def cache_invalidate(cache: DataFrame, touched: DataFrame) -> DataFrame:
    """An ingest or removal clears all requests of the buckets it touched."""
    keys = CACHE_KEY[:3]
    return cache.join(touched.select(*keys).distinct(), keys, "left_anti")
