"""Layouts that bound what moves: fusion in blocks, sets in tiles, symmetric counts, screened searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.operators import evaluate, fusion, matches, neardup, regions, signature_join, similarity
from simloom.plans import aggregates
from test_fusion import WEIGHTS, lists
from test_signatures import items as signatures

LITTLE = "/root/testdata/sf0.01"


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["borda", "mean", "radicals"])
def test_queries_give_the_whole_fusion(spark, how):
    n = spark.read.parquet(f"{LITTLE}/embeddings.parquet").count()
    got = getattr(aggregates, f"fuse_{how}")(spark, LITTLE).groupBy("query_id").count().collect()
    assert got and {r["count"] for r in got} == {n}


@pytest.mark.parametrize("how,options", [("mean", {}), ("product", {"scale": 1.6}), ("radicals", {}), ("borda", {})])
@pytest.mark.parametrize("k", [None, 5])
def test_fusion_in_blocks_equals_fusion_of_rows(spark, how, options, k):
    items = lists(spark, n=40)
    if how != "borda":  # an item without a list, one with a list twice
        items = items.filter("item_id <> 3 OR by <> 'b'").unionByName(items.filter("item_id = 14"))
    queries = items.filter("item_id % 13 = 1").withColumnRenamed("item_id", "query_id")
    fused = fusion.FUSIONS[how](similarity.search(queries, items, scale=1.0), WEIGHTS, **options)
    want = fused if k is None else similarity.ranked(fused, k).select("query_id", "item_id", "dist")
    assert found(fusion.top_fused(queries, items, WEIGHTS, how, k, fused_scale=options.get("scale"))) == found(want)


def test_no_list_is_written(spark):
    items = lists(spark, n=40)
    queries = items.filter("item_id % 13 = 1").withColumnRenamed("item_id", "query_id")
    plan = fusion.top_fused(queries, items, WEIGHTS, "mean", None)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_sets_in_tiles_equal_sets_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(matches, "CHUNK_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = [(n // 3, n, [float(v) for v in rng.normal(size=4)]) for n in range(60)]
    rows += [(0, 0, rows[0][2]), (30, 90, [1.0] * 4), (31, 91, None)]  # a row twice, a lone row, a row without a vector
    df = spark.createDataFrame(rows, "set_id bigint, row bigint, vec array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(0, 20, 7) for b in [*range(20), 30, 31] if a != b] + [(0, 1)], "set_a bigint, set_b bigint")
    whole = df.filter("vec IS NOT NULL")
    want = found(matches._in_pieces(pairs.distinct(), whole, 1.0, similarity.metric_of("l2"), 2))
    assert found(matches.set_distance(pairs, df)) == want and len(want) == 3 * 20
    assert found(matches.set_distance(pairs.distinct(), df, block_rows=3)) == want


def test_screened_search_with_many_equal_distances(spark):
    rng = np.random.default_rng(5)
    mat = np.r_[np.repeat(rng.normal(size=(40, 3)), 5, axis=0), rng.normal(size=(900, 3)) + 4.0]
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(mat)], "item_id bigint, vec array<double>")
    d = np.sqrt(((mat[:, None] - mat[None]) ** 2).sum(axis=2))
    for scale, skip, layout in ((None, "id", {}), (1.0, None, {"scan_rows": 0, "block_rows": 300})):
        u = np.round(d if scale is None else 2 / np.pi * np.arctan(np.pi / 2 * d), 6)
        want = [(a, b, u[a, b]) for a in range(len(mat)) for b in [b for b in np.lexsort((np.arange(len(mat)), u[a])) if skip is None or b != a][:4]]
        got = similarity.search(x.withColumnRenamed("item_id", "query_id"), x, top_n=4, skip=skip, scale=scale, **layout)
        assert found(got.select("query_id", "item_id", "dist")) == sorted(want)


def test_histograms_of_a_task_are_one(spark):
    rng = np.random.default_rng(6)
    x = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(200, 3)))], "item_id bigint, label bigint, vec array<double>")
    q = similarity._prepare(x, "item_id")
    rows = similarity.tile_rows(q, q, similarity.metric_of("l2"), block_rows=2, mirror=True)
    parts = -(-200 // 16)
    assert rows.count() == 200 * (parts + 1)  # each pair of parts once
    assert found(evaluate.pair_counts(x, scan_rows=0, block_rows=2)) == found(evaluate.pair_counts(x))
    # An asymmetric distance has both sides.
    assert found(evaluate.pair_counts(x, "chi2", scan_rows=0, block_rows=2)) == found(evaluate.pair_counts(x, "chi2"))


def test_signatures_whose_lists_hold_most_pairs(spark, monkeypatch):
    x = signatures(spark)
    q = x.withColumnRenamed("item_id", "query_id")
    want = found(signature_join.join_signature(q, x, 8, 0.75, 0.2))
    monkeypatch.setattr(signature_join, "LIST_PAIRS", 10)
    blocks = signature_join.join_signature(q, x, 8, 0.75, 0.2)
    assert "MapInArrow" in blocks._jdf.queryExecution().toString() and found(blocks) == want


def test_images_in_turn_equal_proposals(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(g), int(f), bool(s), int(a)) for i, g, f, s, a in zip(
        rng.integers(0, 6, 300), rng.integers(0, 12, 300), rng.integers(0, 12, 300), rng.integers(0, 2, 300), rng.integers(1, 9, 300))]
    rows = list({r[:3]: r for r in rows}.values()) + [rows[0]]
    pairs = spark.createDataFrame(rows, "img bigint, given bigint, found bigint, same boolean, area bigint").dropDuplicates(["img", "given", "found"])
    want = found(regions._by_proposals(pairs).select("img", "given", "found"))
    assert found(regions.one_to_one(pairs).select("img", "given", "found")) == want
    monkeypatch.setattr(regions, "IMAGE_PAIRS", 40)
    assert found(regions.one_to_one(pairs).select("img", "given", "found")) == want


def test_few_probes_meet_all_without_bands(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [int(v) for v in rng.integers(0, 3, 16)]) for i in range(80)]
    x = spark.createDataFrame(rows, "item_id bigint, sketch array<bigint>")
    q = x.filter("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    got = found(neardup.against(q, x, scale=0.8))
    monkeypatch.setattr(neardup, "SCAN_ROWS", 0)
    assert got == found(neardup.against(q, x, scale=0.8)) and got


def test_points_compile(spark):
    p = lambda x, y: F.struct(F.col("id").cast("int").alias("x"), F.lit(y).alias("y")) if x else F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    df = spark.range(1, 3)
    for nose, mouth, n in ((1, 1, 4), (1, 0, 3), (0, 1, 3), (0, 0, 2)):
        out = df.select(rects.region_from_points(p(1, 2), p(1, 9), p(nose, 5), p(mouth, 7)).alias("g"))
        assert {len(r.g.subs) for r in out.collect()} == {n}
        assert "lambda" not in out._jdf.queryExecution().toString()
