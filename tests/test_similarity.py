"""Block layout against scan layout and brute force, with hot regions of space."""

import numpy as np
import pytest

from simloom.operators import ann, evaluate, similarity, tune

BLOCKS = {"scan_rows": 0, "block_rows": 7}


def frame(spark, mat, ids=None, **extra):
    ids = list(range(len(mat))) if ids is None else ids
    rows = [(i, *[extra[k][n] for k in extra], [float(v) for v in mat[n]]) for n, i in enumerate(ids)]
    kind = "string" if isinstance(ids[0], str) else "bigint"
    types = {"label": "bigint", "by": "string", "kind": "int"}
    return spark.createDataFrame(rows, ", ".join([f"item_id {kind}", *[f"{k} {types[k]}" for k in extra], "vec array<double>"]))


def hot(n=90, dim=5, seed=3):
    """A third of the rows are one vector, another part sits close to it."""
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, dim))
    mat[: n // 3] = mat[0]
    mat[n // 3 : n // 2] = mat[0] + rng.normal(size=(n // 2 - n // 3, dim)) * 0.01
    return mat


def rows(df):
    return sorted((r.query_id, r.item_id, r.dist, r["rank"]) for r in df.collect())


def brute(metric, q, x, qi, xi, top_n=None, max_dist=None, skip=None):
    d = np.round(similarity.METRICS[metric].block(q, x), 6) + 0.0
    out = []
    for a in range(len(q)):
        hits = sorted((d[a, b], xi[b]) for b in range(len(x))
                      if (max_dist is None or d[a, b] <= max_dist)
                      and not (skip == "id" and qi[a] == xi[b]) and not (skip == "zero" and d[a, b] == 0))
        out += [(qi[a], i, dist, n + 1) for n, (dist, i) in enumerate(hits[:top_n])]
    return sorted(out)


HOWS = [{"top_n": 4}, {"max_dist": 1.2}, {"top_n": 4, "skip": "id"}, {"top_n": 3, "skip": "zero"},
        {"top_n": 5, "max_dist": 1.0, "skip": "id"}]


@pytest.mark.parametrize(
    "metric, how", [("l2", h) for h in HOWS] + [(m, h) for m in ("l1", "hamming", "chi2") for h in HOWS[:2]]
)
def test_layouts_agree_with_brute_force(spark, metric, how):
    mat = hot()
    x = frame(spark, mat).repartition(4)
    q = x.withColumnRenamed("item_id", "query_id")
    want = brute(metric, mat, mat, range(90), range(90), **how)
    assert rows(similarity.search(q, x, metric=metric, rank=True, **how)) == want
    assert rows(similarity.search(q, x, metric=metric, rank=True, **how, **BLOCKS)) == want


def test_string_ids_and_by_groups(spark):
    mat = hot(60)
    ids = [f"id{n:03d}" for n in range(60)]
    x = frame(spark, mat, ids, by=["abc"[n % 3] for n in range(60)])
    q = x.withColumnRenamed("item_id", "query_id")
    want = []
    for g in range(3):
        at = [n for n in range(60) if n % 3 == g]
        names = [ids[n] for n in at]
        want += brute("l2", mat[at], mat[at], names, names, top_n=3, skip="id")
    for layout in ({}, BLOCKS):
        assert rows(similarity.search(q, x, top_n=3, skip="id", **layout)) == sorted(want)


def test_pivot_radius_matches_plain_radius(spark):
    mat = hot()
    x = frame(spark, mat)
    q = x.withColumnRenamed("item_id", "query_id")
    want = rows(similarity.search(q, x, max_dist=0.8, rank=True))
    for layout in ({}, BLOCKS):
        assert rows(similarity.ranked(similarity.pivot_radius(q, x, 0.8, **layout).drop("by"))) == want


def test_far_cells_are_skipped():
    metric = similarity.METRICS["l2"]
    pivots = {"": np.array([[0.0, 0.0], [10.0, 0.0]])}
    stats = {"": {0: (50, 1.0, 5), 1: (50, 1.0, 5)}}
    kept = similarity._kept_cells(metric, pivots, stats, stats, 2.0, None)
    assert {(a, b) for _, a, b, _ in kept} == {(0, 0), (1, 1)}
    near = similarity._kept_cells(metric, pivots, stats, stats, None, 10)
    assert {(a, b) for _, a, b, _ in near} == {(0, 0), (1, 1)}
    all_of_them = similarity._kept_cells(metric, pivots, stats, stats, None, 80)
    assert len(all_of_them) == 4


def test_pair_counts_in_both_layouts(spark):
    mat = hot(50)
    x = frame(spark, mat, label=[n % 4 for n in range(50)])
    one = sorted(map(tuple, evaluate.pair_counts(x).collect()))
    two = sorted(map(tuple, evaluate.pair_counts(x, **BLOCKS).collect()))
    assert one == two
    assert sum(r[1] + r[2] for r in one) == 50 * 49
    grid = tune.weight_grid(2, (0.3, 0.9))
    cuts = [(0, 2), (2, 5)]
    a, b = (sorted(map(tuple, tune.weight_counts(x, cuts, grid, 0.6, 1.6, **h).collect())) for h in ({}, BLOCKS))
    assert a == b


def test_tuned_weights_refine(spark):
    x = frame(spark, hot(40), label=[n % 3 for n in range(40)])
    first = tune.tune_weights(x, [(0, 2), (2, 5)], t=0.6, scale=1.6)
    second = tune.tune_weights(x, [(0, 2), (2, 5)], t=0.6, scale=1.6, rounds=2)
    best = lambda df: max(r.f for r in df.collect())
    assert best(second) >= best(first)


def test_penalty_and_distance_bounds(spark):
    x = frame(spark, hot(40), kind=[n % 2 for n in range(40)])
    q = x.withColumnRenamed("item_id", "query_id")
    got = similarity.search_penalised(q, x, max_dist=0.7, scale=1.0).collect()
    plain = {(r.query_id, r.item_id): r.dist for r in similarity.search(q, x, scale=1.0).collect()}
    assert all(0 <= d <= 1 for d in plain.values())
    assert all(d == 0 for (a, b), d in plain.items() if a == b)
    for r in got:
        d = plain[r.query_id, r.item_id]
        assert r.dist == pytest.approx(d if r.query_id % 2 == r.item_id % 2 else d**0.5, abs=1e-6)


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 3
    mat = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * 0.5
    x = frame(spark, mat)
    q = x.withColumnRenamed("item_id", "query_id")
    exact = {(r[0], r[1]) for r in rows(similarity.search(q, x, top_n=10, skip="id"))}
    for find in (ann.lsh_neighbours, ann.cell_neighbours):
        got = {(r.query_id, r.item_id) for r in find(q, x, top_n=10).collect()}
        assert len(got & exact) / len(exact) > 0.8


def test_approximate_recall_with_the_layout_of_large_tables(spark):
    """Planes of a million items and a cell for every four items, over vectors whose neighbours lie at about 50 degrees."""
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(2000, 12))
    x = frame(spark, mat)
    q = x.withColumnRenamed("item_id", "query_id").filter("query_id % 20 = 0")
    exact = {(r[0], r[1]) for r in rows(similarity.search(q, x, top_n=5, skip="id"))}
    centres = mat[rng.choice(2000, 500, replace=False)]
    share = lambda found: len({(r.query_id, r.item_id) for r in found.collect()} & exact) / len(exact)
    lsh, cells = ann.lsh_neighbours(q, x, top_n=5, planes=15), ann.cell_neighbours(q, x, top_n=5, centres=centres)
    before = share(ann.lsh_neighbours(q, x, top_n=5, planes=15, unsure=0)), share(ann.cell_neighbours(q, x, top_n=5, centres=centres, probes=8 + 22))
    now = share(lsh), share(cells)
    print("recall, one bucket a table and 30 cells:", before, "measured probes:", now)
    assert min(now) >= 0.9 > max(before)


LITTLE = "/root/testdata/sf0.01"


def test_sets_far_apart_in_id_are_met(spark):
    from pyspark.sql import functions as F

    from simloom.plans import joins

    met = joins.join_set_nearest_all(spark, LITTLE)
    sets = spark.read.parquet(f"{LITTLE}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4).alias("s")).distinct()
    assert met.count() == sets.filter("s % 50 = 0").count() * (sets.count() - 1) > 0
    assert met.filter("abs(set_b - set_a) > 8").count()


def test_uncut_fusion_covers_every_item(spark):
    from simloom.plans import aggregates

    n = spark.read.parquet(f"{LITTLE}/embeddings.parquet").count()
    got = aggregates.fuse_mean_uncut(spark, LITTLE).groupBy("query_id").count().collect()
    assert got and {r["count"] for r in got} == {n}


@pytest.mark.parametrize("grid", [2, 5])
def test_rows_of_the_grid_do_not_grow_with_the_table(spark, grid):
    for n in (60, 240):
        x = similarity._prepare(frame(spark, hot(n)), "item_id")
        rows = similarity.tile_rows(x, x, similarity.metric_of("chi2"), grid=grid)
        assert rows.count() == 2 * grid * n


@pytest.mark.parametrize("metric", ["l2", "chi2"])
def test_the_grid_gives_the_rows_of_a_scan(spark, metric):
    mat = np.abs(hot(300))
    x = frame(spark, mat, ids=[f"i{n:03d}" for n in range(300)], by=["a" if n % 3 else "b" for n in range(300)])
    q = x.withColumnRenamed("item_id", "query_id")
    one = rows(similarity.search(q, x, metric, top_n=4, skip="id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for layout in ({"block_rows": 7}, {"block_rows": 5, "grid": 3}, {"block_rows": 1000}):
            assert rows(similarity.search(q, x, metric, top_n=4, skip="id", scan_rows=0, **layout)) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("layout", [{}, BLOCKS])
def test_pair_counts_of_distances_far_apart(spark, layout):
    mat = np.array([[0.0, 0.0], [3.0, 4.0], [9000.0, 0.0], [900_000.0, 5.0]])
    got = {r["bin"]: (r["same"], r["other"]) for r in evaluate.pair_counts(frame(spark, mat, label=[1, 1, 2, 2]), scale=None, **layout).collect()}
    want = {}
    for i in range(4):
        for j in range(4):
            if i != j:
                key = int(np.rint(np.round(np.sqrt(((mat[i] - mat[j]) ** 2).sum()), evaluate.RESOLUTION) * 10**evaluate.RESOLUTION))
                same, other = want.get(key, (0, 0))
                want[key] = (same + ((i < 2) == (j < 2)), other + ((i < 2) != (j < 2)))
    assert got == want
