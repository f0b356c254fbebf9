"""Live item tables: ingest, queries, mixed request logs, near-duplicates and cache eviction.

Ranking needs windows and joins that a streaming plan does not allow, so each micro-batch runs as a
batch job (``foreachBatch``). All writes are keyed by the batch number: a replayed batch replaces its
own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from simloom.operators import neardup, similarity
from simloom.operators.prefix import running
from simloom.sources.tables import LogTable, PartedLog


def latest_in_batch(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the one with the highest ``seq``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def ingest(stream: DataFrame, store: LogTable, checkpoint: str) -> DataStreamWriter:
    """Add or replace items as they arrive (key, seq, deleted, payload)."""
    def step(rows: DataFrame, batch: int) -> None:
        store.add(latest_in_batch(rows, store.key), batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def answer(stream: DataFrame, index: LogTable | DataFrame, out: str, checkpoint: str, **how) -> DataStreamWriter:
    """Rank every arriving query (query_id, vec) against the index as it is now."""
    def step(queries: DataFrame, batch: int) -> None:
        items = index.read() if isinstance(index, LogTable) else index
        if items is not None:
            similarity.search(queries, items, **how).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def request_log(stream: DataFrame, store: LogTable, out: str, checkpoint: str) -> DataStreamWriter:
    """A mixed log (seq, op, item_id) applied in seq order: i ingests, r removes, q asks whether
    the item is there at that moment; other ops only count. Answers go to ``out``."""
    def step(log: DataFrame, batch: int) -> None:
        before = store.read(before=batch, only=log)
        change = F.when(F.col("op") == "i", F.col("seq") * 2 + 1).when(F.col("op") == "r", F.col("seq") * 2)
        seen = running(log.withColumn("_c", change), ["item_id"], ["seq"], last=("max", F.col("_c")))
        asked = seen.filter(F.col("op") == "q")
        if before is None:
            known = asked.withColumn("_in", F.lit(False))
        else:
            known = asked.join(before.select("item_id", F.lit(True).alias("_in")), "item_id", "left")
        known.select(
            "seq", "item_id",
            F.when(F.col("last").isNotNull(), F.col("last") % 2 == 1).otherwise(F.coalesce("_in", F.lit(False))).alias("present"),
        ).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        changes = log.filter(F.col("op").isin("i", "r")).select("item_id", "seq", (F.col("op") == "r").alias("deleted"))
        store.add(latest_in_batch(changes, "item_id"), batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def link_arrivals(stream: DataFrame, sketches: str | PartedLog, links: str, checkpoint: str, **how) -> DataStreamWriter:
    """Link each arriving item (seq, sketch) to its closest earlier one.

    Items must arrive in seq order over batches. ``sketches`` keeps the first item of every sketch once
    per band, in folders by the hash of the band; a batch opens the folders of its own bands.
    """
    near = {k: v for k, v in how.items() if k in ("scale", "threshold", "positions")}
    keep = PartedLog(stream.sparkSession, sketches, ["key"]) if isinstance(sketches, str) else sketches

    def step(rows: DataFrame, batch: int) -> None:
        fresh = rows.select("seq", "sketch", F.explode(neardup.band_keys(F.col("sketch"), **near)).alias("key"))
        stored = keep.read(before=batch, only=fresh)
        known, firsts = rows.select("seq", "sketch"), fresh
        if stored is not None:
            known = known.unionByName(stored.select("seq", "sketch").distinct())
            firsts = fresh.join(stored.select("key", "sketch"), ["key", "sketch"], "left_anti")
        neardup.link_probes(rows.select("seq", "sketch"), known, **how).write.mode("overwrite").parquet(f"{links}/batch={batch}")
        keep.add(firsts.groupBy("key", "sketch").agg(F.min("seq").alias("seq")), batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def evict(stream: DataFrame, cache: LogTable, keys: list[str], checkpoint: str) -> DataStreamWriter:
    """Ingest and remove events (with the bucket ``keys``) evict the cached rows of their buckets.

    A cache whose folders go by ``keys`` is read in the folders of the buckets that a batch touches.
    """
    def step(events: DataFrame, batch: int) -> None:
        # The cache's own rows are batches under zero, evictions follow them.
        near = events if sorted(cache.by) == sorted(keys) else None
        current = cache.read(before=batch, only=near)
        if current is not None:
            gone = current.join(events.select(*keys).distinct(), keys, "left_semi")
            cache.add(gone.withColumn("seq", F.col("seq") + 1).withColumn("deleted", F.lit(True)), batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def autosave(stream: DataFrame, path: str, checkpoint: str, every: str | None = "30 minutes") -> DataStreamWriter:
    """Persist arriving rows in intervals; with ``every=None`` what is there now, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
