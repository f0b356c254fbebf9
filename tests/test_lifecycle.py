"""Life of an item table, streams against batch, and scalar properties."""

import math
import os
import random
from urllib.parse import unquote, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import scalars
from simloom.operators import maintenance, neardup, ranking, similarity
from simloom.session import scratch_path
from simloom.sources import results, tables
from simloom.sources.tables import LogTable, VersionedTable
from simloom.streaming import live, monitor


def make(spark, ids, shift=0.0, seq=0):
    rnd = random.Random(7)
    rows = [(f"dir/{i}.png", seq, f"g{i % 3}", [rnd.random() + shift for _ in range(4)]) for i in ids]
    return spark.createDataFrame(rows, "item_id string, seq bigint, label string, vec array<double>")


def test_life_cycle(spark):
    store = VersionedTable(spark, scratch_path(spark, "life"))
    assert store.read() is None
    first = make(spark, range(20))
    store.write(first)
    query = first.filter("item_id = 'dir/3.png'").withColumnRenamed("item_id", "query_id")
    for t, most in ((3, 3), (0.5, 20), (5.4, 5), (-1, 20)):
        top_n, max_dist = scalars.split_threshold(t)
        hits = similarity.search(query, store.read(), scale=1.0)
        kept = ranking.trim(hits.drop("by"), t).collect()
        assert 0 < len(kept) <= most and all(0 <= r.dist <= 1 for r in kept)
        assert max_dist is None or all(r.dist <= max_dist for r in kept)
    assert ranking.trim(hits.drop("by"), 0).first().item_id == "dir/3.png"
    store.write(maintenance.upsert(store.read(), make(spark, range(5), shift=1.0, seq=1)))
    assert store.read().count() == 20
    changed = maintenance.index_difference(store.read(0), store.read(1))
    assert {r.difference for r in changed.collect()} == {"value"} and changed.count() == 5
    gone = spark.createDataFrame([("dir/7.png",), ("9.png",), ("g1",)], "needle string")
    store.write(maintenance.remove_listed(store.read(), gone))
    left = {r.item_id for r in store.read().collect()}
    assert left == {f"dir/{i}.png" for i in range(20) if i not in (7, 9) and i % 3 != 1}
    assert {r.name: r.n for r in maintenance.list_items(store.read(), "@").collect()} == {"g0": 6, "g2": 6}
    assert maintenance.list_items(store.read(), "count png").first().n == len(left)
    path = scratch_path(spark, "saved") + ".json"
    tables.save_items(store.read(), path)
    back = tables.load_items(spark, path, schema=store.read().schema)
    assert maintenance.index_difference(store.read(), back).isEmpty()
    assert store.write(store.read().limit(0)) == 3 and store.read().isEmpty()
    assert store.write(first, version=2) == 2 and len(store.versions()) == 4


def test_log_table_replays_and_compacts(spark):
    log = LogTable(spark, scratch_path(spark, "log"))

    def rows(*r):
        return spark.createDataFrame(r, "item_id bigint, seq bigint, deleted boolean, v int")

    log.add(rows((1, 1, False, 10), (2, 1, False, 20)), 0)
    log.add(rows((1, 2, False, 11)), 1)
    log.add(rows((1, 2, False, 11)), 1)
    log.add(rows((2, 3, True, 0)), 2)
    assert [(r.item_id, r.v) for r in log.read().collect()] == [(1, 11)]
    assert sorted((r.item_id, r.v) for r in log.read(before=1).collect()) == [(1, 10), (2, 20)]
    log.compact()
    log.add(rows((3, 4, False, 30)), 3)
    assert sorted((r.item_id, r.v) for r in log.read().collect()) == [(1, 11), (3, 30)]


def test_ensemble_round_trip(spark):
    long = spark.createDataFrame([(1, "a", [1.0]), (1, "b", [2.0]), (2, "a", [3.0])], "item_id bigint, by string, vec array<double>")
    wide = maintenance.to_wide(long, ["a", "b"])
    assert sorted(map(tuple, maintenance.to_long(wide, ["a", "b"]).collect())) == sorted(map(tuple, long.collect()))


def test_merge_of_parts_equals_whole(spark):
    x = make(spark, range(30))
    q = x.withColumnRenamed("item_id", "query_id")
    whole = similarity.search(q, x, top_n=4).drop("by")
    parts = similarity.search(q, x.filter(F.col("label") == "g0"), top_n=4)
    for g in ("g1", "g2"):
        parts = parts.unionByName(similarity.search(q, x.filter(F.col("label") == g), top_n=4))
    got = ranking.merge_top_k(parts, 4)
    key = lambda df: sorted((r.query_id, r.item_id, r.dist, r["rank"]) for r in df.collect())
    assert key(got) == key(whole)
    text = results.parse_results_text(results.results_text(whole, 4), "query_id").collect()
    assert {(r.query, r.item) for r in text} == {(r.query_id, r.item_id) for r in whole.collect()}


def test_streamed_counts_equal_batch(spark):
    rows = spark.createDataFrame([(i * 97 % 86_400, "ab"[i % 2]) for i in range(400)], "s bigint, kind string")
    events = rows.select(F.timestamp_seconds("s").alias("ts"), "kind")
    root = scratch_path(spark, "counts")
    events.write.parquet(root + "/in")
    stream = spark.readStream.schema(events.schema).parquet(root + "/in")
    for plan, field in ((monitor.tumbling, "window"), (monitor.sliding, "window"), (monitor.sessions, "session_window")):
        name = plan.__name__
        out = plan(stream, watermark="1 hour").writeStream.format("memory").queryName(name).outputMode("complete")
        out.trigger(availableNow=True).start().awaitTermination()
        pick = lambda df: sorted((r[field].start, r.kind, r.n) for r in df.collect())  # noqa: B023, E731
        assert pick(spark.table(name)) == pick(plan(events))


def test_live_query_uses_the_current_index(spark):
    index = LogTable(spark, scratch_path(spark, "index"))
    index.add(make(spark, range(8)).withColumn("deleted", F.lit(False)), 0)
    root = scratch_path(spark, "ask")
    make(spark, range(8)).select(F.col("item_id").alias("query_id"), "vec").write.parquet(root + "/in")
    stream = spark.readStream.schema("query_id string, vec array<double>").parquet(root + "/in")
    live.answer(stream, index, root + "/out", root + "/cp", top_n=1).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(root + "/out").collect()
    assert len(got) == 8 and all(r.query_id == r.item_id and r.dist == 0 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 0.99))
def test_real_inverts_unit(d):
    back = 2 / math.pi * math.atan(math.pi / 2 * scalars.real_value(d))
    assert math.isclose(back, d, abs_tol=1e-9)


@given(st.floats(-5, 2000))
def test_threshold_grammar(t):
    n, d = scalars.split_threshold(t)
    if t < 0:
        assert (n, d) == (None, None)
    elif t < 1:
        assert n is None and d == t
    else:
        assert n == int(t) and (d is None or 0 < d < 1)


def opened(df):
    """Bytes of the files that a table was read from after pruning."""
    files = [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in files if f)


def test_a_batch_reads_what_it_touches(spark):
    asked = spark.range(3).select((F.col("id") * 7).alias("item_id"))
    read, whole = [], []
    for n in (4_000, 32_000):
        log = LogTable(spark, scratch_path(spark, "grown"), part_rows=250)
        rows = spark.range(n).select(F.col("id").alias("item_id"), F.lit(1).alias("seq"), F.lit(False).alias("deleted"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("v"))
        log.add(rows, 0)
        log.compact()
        got = log.read(only=asked)
        assert sorted(r.item_id for r in got.collect()) == [0, 7, 14]
        read.append(opened(got))
        whole.append(opened(log.read()))
    assert 0 < read[1] <= 1.5 * read[0] and whole[1] > 5 * whole[0]


def test_log_against_a_dictionary(spark):
    """Batches, replays and compaction after every third batch leave the latest rows."""
    rnd = random.Random(3)
    log = LogTable(spark, scratch_path(spark, "log"), part_rows=8, compact_every=3)
    now = {}
    for batch in range(7):
        rows = [(k, batch, rnd.random() < 0.3, rnd.randrange(9)) for k in rnd.sample(range(40), 12)]
        frame = spark.createDataFrame(rows, "item_id bigint, seq bigint, deleted boolean, v int").coalesce(1)
        log.add(frame, batch)
        log.add(frame, batch)
        before = dict(now)
        for k, _, gone, v in rows:
            now.pop(k, None)
            if not gone:
                now[k] = v
        assert {r.item_id: r.v for r in log.read().collect()} == now
        if batch:
            assert {r.item_id: r.v for r in log.read(before=batch).collect()} == before
    assert log._numbers("base") and log.read(only=spark.createDataFrame([(-1,)], "item_id bigint")).isEmpty()


def test_arrivals_link_as_in_a_batch(spark):
    rnd = random.Random(5)
    base = [[rnd.randrange(50) for _ in range(16)] for _ in range(20)]
    rows = [(i, [v if rnd.random() < 0.9 else rnd.randrange(50) for v in base[i % 20]]) for i in range(120)]
    items = spark.createDataFrame(rows, "seq bigint, sketch array<bigint>")
    root = scratch_path(spark, "arrivals")
    keep = tables.PartedLog(spark, root + "/sketches", ["key"], part_rows=20, compact_every=2)
    for n in range(4):
        items.filter(F.floor(F.col("seq") / 30) == n).coalesce(1).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema(items.schema).parquet(root + "/in")
        live.link_arrivals(stream, keep, root + "/links", root + "/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(root + "/links").select("seq", "parent", "dist").collect()))
    assert got == sorted(map(tuple, neardup.link(items).collect())) and len(got) > 20
    assert keep._numbers("base")
