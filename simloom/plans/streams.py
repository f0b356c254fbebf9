"""Streaming queries, fed from the supplied tables in arrival order and read back when done."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.operators import routing
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import E, as_queries, items, neighbours
from simloom.plans.neardups import LINKS, docs
from simloom.session import scratch_path
from simloom.sources.tables import LogTable
from simloom.streaming import live, monitor


def feed(spark, df, order, chunks, start):
    """Append ``df`` in parts by ``order`` and let the query of ``start(stream, checkpoint)`` take
    each part before the next arrives."""
    root = scratch_path(spark, "stream")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - low) * chunks / (high - low + 1)), F.lit(chunks - 1))
    for n in range(chunks):
        df.filter(part == n).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema(df.schema).parquet(root + "/in")
        start(stream, root + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return root


def log(spark, sf):
    """Events as requests on items (one item per user)."""
    op = (
        F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "r")
        .when(F.col("event_type") == "view", "q").otherwise("l")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("item_id"), "value"
    )


@query("stream_ingest",
       "SELECT item_id, seq, value FROM (SELECT user_id AS item_id, event_id AS seq, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def stream_ingest(spark, sf):
    store = LogTable(spark, scratch_path(spark, "live"))
    rows = log(spark, sf).select("item_id", "seq", "value", (F.col("op") == "r").alias("deleted"))
    feed(spark, rows, "seq", 3, lambda s, c: live.ingest(s, store, c))
    store.compact()
    return store.read().select("item_id", "seq", "value")


@query("stream_query",
       f"WITH {neighbours(3)} SELECT qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM n")
def stream_query(spark, sf):
    x = items(spark, sf)
    out = scratch_path(spark, "answers")
    feed(spark, as_queries(x).select("query_id", "vec"), "query_id", 2,
         lambda s, c: live.answer(s, x.select("item_id", "vec"), out, c, top_n=3, skip="id"))
    return spark.read.parquet(out).select("query_id", "item_id", "dist", "rank")


@query("stream_request_log",
       "WITH s AS (SELECT event_id AS seq, event_type, user_id AS item_id, last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) "
       "OVER (PARTITION BY user_id ORDER BY event_id) AS state FROM events) SELECT seq, item_id, coalesce(state, false) AS present FROM s WHERE event_type = 'view'")
def stream_request_log(spark, sf):
    store = LogTable(spark, scratch_path(spark, "live"))
    out = scratch_path(spark, "answers")
    feed(spark, log(spark, sf).drop("value"), "seq", 3, lambda s, c: live.request_log(s, store, out, c))
    return spark.read.parquet(out).select("seq", "item_id", "present")


@query("stream_neardup", f"WITH {LINKS} SELECT seq, parent, dist FROM k")
def stream_neardup(spark, sf):
    sketches, links = scratch_path(spark, "sketches"), scratch_path(spark, "links")
    feed(spark, docs(spark, sf), "seq", 2, lambda s, c: live.link_arrivals(s, sketches, links, c))
    return spark.read.parquet(links).select("seq", "parent", "dist")


@query("stream_autosave", "SELECT event_id AS seq, user_id AS item_id, value FROM events")
def stream_autosave(spark, sf):
    path = scratch_path(spark, "saved")
    feed(spark, log(spark, sf), "seq", 2, lambda s, c: live.autosave(s, path, c, every=None))
    return spark.read.schema("seq bigint, item_id bigint, value double").parquet(path).select("seq", "item_id", "value")


@query("stream_outstanding",
       "WITH m AS (SELECT event_id, epoch_us(ts) AS mark, 1 AS step FROM events UNION ALL SELECT event_id, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT), -1 FROM events) "
       "SELECT event_id, CAST(step AS BIGINT) AS step, CAST(sum(step) OVER (ORDER BY mark, step, event_id) AS BIGINT) AS in_flight FROM m")
def stream_outstanding(spark, sf):
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    end = start + F.round(F.col("value") * 60_000_000).cast("bigint")
    out = monitor.outstanding(table(spark, sf, "events"), "event_id", start, end)
    return out.select("event_id", F.col("step").cast("bigint").alias("step"), "in_flight")


@query("stream_cache_invalidate",
       "WITH t AS (SELECT DISTINCT o_orderstatus, o_custkey % 20 AS ev, o_orderpriority FROM orders WHERE o_orderkey % 90 = 1) "
       "SELECT CAST(o_orderkey AS VARCHAR) AS request FROM orders WHERE o_orderkey % 3 <> 0 AND NOT EXISTS "
       "(SELECT 1 FROM t WHERE t.o_orderstatus = orders.o_orderstatus AND t.ev = o_custkey % 20 AND t.o_orderpriority = orders.o_orderpriority)")
def stream_cache_invalidate(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("request"), "o_orderkey", F.col("o_orderstatus").alias("app"),
        (F.col("o_custkey") % 20).alias("event_id"), F.col("o_orderpriority").alias("bucket"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("deleted"),
    )
    keys = list(routing.CACHE_KEY[:3])
    cache = LogTable(spark, scratch_path(spark, "cache"), key="request", by=keys)
    cache.add(rows.filter("o_orderkey % 3 <> 0").drop("o_orderkey"), -1)
    cache.compact()
    touched = rows.filter("o_orderkey % 90 = 1").select("o_orderkey", *keys)
    feed(spark, touched, "o_orderkey", 2, lambda s, c: live.evict(s, cache, keys, c))
    return cache.read().select("request")


_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("stream_counts",
       "WITH e AS (SELECT ts, event_type AS kind FROM events), "
       "t AS (SELECT 'tumbling' AS shape, kind, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM e GROUP BY ALL), "
       "l AS (SELECT 'sliding' AS shape, kind, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS s, count(*) AS n FROM e, (SELECT unnest([0, 1]) AS o) GROUP BY ALL), "
       "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY kind ORDER BY ts)), "
       "p AS (SELECT *, sum(fresh) OVER (PARTITION BY kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), "
       "z AS (SELECT 'session' AS shape, kind, min(ts) AS s, count(*) AS n FROM p GROUP BY kind, no) "
       f"SELECT shape, kind, {_T.format('s')} AS start, CAST(n AS BIGINT) AS n FROM (FROM t UNION ALL FROM l UNION ALL FROM z)")
def stream_counts(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("kind"))
    shapes = {
        "tumbling": (monitor.tumbling(e), "window"), "sliding": (monitor.sliding(e), "window"),
        "session": (monitor.sessions(e), "session_window"),
    }
    out = None
    for name, (df, w) in shapes.items():
        one = df.select(F.lit(name).alias("shape"), "kind", F.date_format(f"{w}.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
        out = one if out is None else out.unionByName(one)
    return out
