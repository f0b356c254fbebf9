"""Layouts and kernels for large tables: what is computed in full, copied or moved, with the results of the plain way."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.functions.scalars import real_value
from simloom.operators import evaluate, fusion, matches, signature_join, similarity, tune
from test_fusion import WEIGHTS, lists
from test_signatures import items as signatures


def found(df):
    return sorted(map(tuple, df.collect()))


def test_few_pairs_are_weighed_in_full(monkeypatch):
    rng = np.random.default_rng(2)
    cuts, grid = [(0, 8), (8, 16), (16, 24)], np.array(tune.weight_grid(3, (0.0, 0.3, 0.9)))
    mat = rng.normal(size=(600, 24)) * 0.3 * rng.uniform(0.5, 2.0, (600, 1))
    mat[50:60], mat[70, :8], mat[80] = mat[40:50], mat[71, :8], mat[81] * (1 + 1e-9)
    ids, tag = np.arange(600), np.arange(600) % 5
    q, x = similarity.Block(ids[:300], mat[:300], tag[:300]), similarity.Block(ids, mat, tag)
    ids[90] = ids[91]  # an id that comes twice
    cells = 0

    def counted(d, scale, plain=tune.unit_values):
        nonlocal cells
        cells += d.size if d.size < 1 << 20 else 0  # a table of logarithms is larger
        return plain(d, scale)

    monkeypatch.setattr(tune, "unit_values", counted)
    for t in (0.2, 0.4, 0.5, 0.6):
        limit = math.log(real_value(t + 5e-7) / 1.6)
        reducer = tune._Products(similarity.metric_of("l2"), cuts, grid, limit)
        list(reducer.add(q, x, 2))
        logs = []
        for a, b in cuts:
            d = np.sqrt(((q.mat[:, None, a:b] - x.mat[None, :, a:b]) ** 2).sum(axis=2))
            with np.errstate(divide="ignore"):
                logs.append(np.log(2 / np.pi * np.arctan(np.pi / 2 * d)))
        zero = np.isneginf(logs).any(axis=0)
        other, alike = q.ids[:, None] != x.ids[None, :], q.tag[:, None] == x.tag[None, :]
        some = [(sum(w * np.where(zero, 0.0, one) for w, one in zip(c, logs)) <= limit) | zero for c in grid]
        assert reducer.found.tolist() == [2 * np.count_nonzero(s & other) for s in some]
        assert reducer.match.tolist() == [2 * np.count_nonzero(s & other & alike) for s in some]
        assert len({*reducer.found.tolist()}) > 3 or t > 0.5
    assert 0 < cells < 0.1 * 4 * len(cuts) * 300 * 600


def test_signatures_meet_by_their_positions(spark, monkeypatch):
    x = signatures(spark).persist()
    q = x.withColumnRenamed("item_id", "query_id")
    want = {(below, scale): found(signature_join.compare_all(q, x, 8, scale, below).filter("dist < 0.45"))
            for below, scale in ((0.6, 0.75),)}[0.6, 0.75]

    def every_pair(a, b):
        raise AssertionError("all pairs are compared at all places")

    plain = signature_join.signature_metric
    monkeypatch.setattr(signature_join, "signature_metric", lambda *of: similarity.Metric(plain(*of).name, None, every_pair, False))
    for layout in ({}, {"scan_rows": 0, "block_rows": 5}):
        assert found(signature_join.compare_all(q, x, 8, 0.75, 0.45, **layout)) == want and want
    assert found(signature_join.compare_all(q, x, 8, 0.75, 0.45, one=True, scan_rows=0, block_rows=2)) == want
    monkeypatch.setattr(signature_join, "LIST_PAIRS", 10)
    twice = x.unionByName(x.filter("item_id < 9"))  # ids that come twice
    got = [signature_join.join_signature(q, x, 8, 0.75, 0.45, scan_rows=0, block_rows=2) for q in (
        twice.withColumnRenamed("item_id", "query_id"), twice.filter("item_id >= 0").withColumnRenamed("item_id", "query_id"))]
    assert found(got[0]) == found(got[1]) and got[0].count() > len(want)


def test_rows_of_sets_go_where_their_pairs_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(n // 3 * 7, n, [float(v) for v in rng.normal(size=4)]) for n in range(600)]
    rows += [(0, 0, rows[0][2]), (30, 900, [1.0] * 4), (None, 901, [1.0] * 4)]  # a row twice, a lone row, a row of no set
    df = spark.createDataFrame(rows, "set_id bigint, row bigint, vec array<double>").filter("set_id IS NOT NULL")
    listed = [(a * 7, b * 7) for a in range(0, 200) for b in (a + 1, (a * 61) % 200) if a != b] + [(0, 7), (0, 30), (30, 0), (30, 5000), (None, 7)]
    pairs = spark.createDataFrame(listed, "set_a bigint, set_b bigint")
    want = found(matches.set_distance(pairs, df))
    assert len(want) > 300
    monkeypatch.setattr(matches, "CHUNK_ROWS", 24)
    got = matches.set_distance(pairs, df)
    assert found(got) == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row goes to all tiles


def test_items_of_whole_lists_are_sent_once(spark, monkeypatch):
    items = lists(spark, n=90)
    queries = items.filter("item_id % 7 = 1").withColumnRenamed("item_id", "query_id")
    monkeypatch.setattr(fusion, "HELD_BYTES", 1)
    if hasattr(fusion, "LEAST_HELD_BYTES"):
        monkeypatch.setattr(fusion, "LEAST_HELD_BYTES", 1)
    for k in (None, 5):
        got = fusion.top_fused(queries, items, WEIGHTS, "borda", k)
        assert "x_split" not in got._jdf.queryExecution().optimizedPlan().toString()
        fused = fusion.fuse_borda(similarity.search(queries, items, scale=1.0), WEIGHTS)
        assert found(got) == found(fused if k is None else similarity.ranked(fused, k).select("query_id", "item_id", "dist"))
    with monkeypatch.context() as m:
        m.setattr(fusion, "SENT_BYTES", 0)
        assert found(fusion.top_fused(queries, items, WEIGHTS, "borda", 5)) == found(got)


def regions_of(spark, rng, n, images):
    kinds = np.array(["f", "p", "i", "q", None])
    rows = [(int(i), int(k), kinds[c], tuple(map(int, r))) for i, k, c, r in zip(
        rng.integers(0, images, n), rng.integers(0, 9, n), rng.integers(0, 5, n), np.c_[rng.integers(0, 30, (n, 2)), rng.integers(-1, 40, (n, 2))])]
    rows += rows[:9] + [(None, 1, "f", (0, 0, 20, 20)), (1, None, "f", (0, 0, 20, 20)), (1, 5, "p", None), (2, 6, "p", (3, None, 20, 20))]
    return spark.createDataFrame(rows, "img bigint, rid bigint, kind string, r struct<x: int, y: int, w: int, h: int>").persist()


@pytest.mark.parametrize("most", [2000, 30, 0])
def test_cascade_moves_regions_only(spark, monkeypatch, most):
    rng = np.random.default_rng(11)
    given, found_ = regions_of(spark, rng, 150, 12), regions_of(spark, rng, 220, 12)

    def subs(shift):
        r = F.col("r")
        two = F.array(*[F.struct((F.col("rid") * 2 + k).alias("rid"), F.lit(kind).alias("kind"), rects.rect(
            r["x"] + k * 3 + shift, r["y"] + shift, (r["w"] / 1.5).cast("int"), (r["h"] / 1.5).cast("int")).alias("r")) for k, kind in enumerate(("i", "odd", "m"))])
        return F.when(F.col("rid") != 4, two)

    columns = subs(F.lit(0)), subs((F.col("rid") % 2).cast("int"))
    tables = [df.select("img", F.col("rid").alias("parent"), F.explode(c).alias("s")).select("img", "parent", "s.rid", "s.kind", "s.r") for df, c in zip((given, found_), columns)]
    want = evaluate.region_counts_cascade(given, found_, *tables, 0.5, 0.6, 4).first()
    if most:
        monkeypatch.setattr(evaluate, "IMAGE_ROWS", most)
    else:  # few rows to a batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = evaluate.region_counts_cascade(given, found_, *columns, 0.5, 0.6, 4).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and want.match > 50
    assert evaluate.region_counts_cascade(given.filter("false"), found_.filter("false"), *columns).first() == (None, None, None)
