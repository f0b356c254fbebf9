"""Region matching and merging on hand-made and random rectangles."""

import random

import pytest
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.operators import evaluate, likelihood, region_merge, regions


def table(spark, rows):
    return spark.createDataFrame(rows, "img bigint, rid bigint, kind string, r struct<x: int, y: int, w: int, h: int>")


def boxes(n=150, images=3, seed=1, spread=60):
    rnd = random.Random(seed)
    return [(i % images, i, rnd.choice("fp"), (rnd.randrange(spread), rnd.randrange(spread), rnd.randrange(9, 30), rnd.randrange(9, 30)))
            for i in range(n)]


GIVEN = [(1, 1, "f", (0, 0, 16, 16)), (1, 2, "p", (20, 20, 16, 16)), (1, 3, "p", (40, 40, 16, 16))]
FOUND = [(1, 1, "f", (1, 1, 16, 16)), (1, 2, "f", (21, 21, 16, 16)), (1, 3, "p", (61, 61, 16, 16))]


@pytest.mark.parametrize("found, weight, f", [(GIVEN, 0.0, 1.0), (FOUND, 0.0, 1 / 3), (FOUND, 0.5, 1 / 2), (FOUND, 1.0, 2 / 3)])
def test_hand_made_scores(spark, found, weight, f):
    counts = evaluate.region_counts(table(spark, GIVEN), table(spark, found), weight, tol=0.5, min_dim=12)
    assert evaluate.with_prf(counts).first().f == pytest.approx(f, abs=1e-6)


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0


def sequential(given, found, tol, min_dim):
    """The greedy assignment one region at a time."""
    free, out = {(f[0], f[1]): f for f in found}, {}
    for img, gid, kind, g in sorted(given):
        best = None
        for (fi, fid), (_, _, fk, f) in free.items():
            c = overlap(g, f)
            if fi == img and c >= min_dim**2 and 1 - c / (g[2] * g[3] + f[2] * f[3] - c) < tol:
                key = (fk == kind, c, -fid)
                best = max(best, key) if best else key
        if best:
            out[img, gid] = -best[2]
            del free[img, -best[2]]
    return out


@pytest.mark.parametrize("grid", [64, 7])
def test_assignment_equals_the_sequential_one(spark, grid):
    given, found = boxes(seed=1, spread=25), boxes(seed=2, spread=25)
    pairs = regions.overlap_pairs(table(spark, given), table(spark, found), tol=0.8, grid=grid)
    got = {(r.img, r.given): r.found for r in regions.one_to_one(pairs).collect()}
    assert got == sequential(given, found, 0.8, 8)


def test_merge_in_parts_equals_merge_of_whole_images(spark, monkeypatch):
    rows = boxes(200, images=2, spread=900)
    fit = [r for r in sorted(rows) if min(r[3][2] / r[3][3], r[3][3] / r[3][2]) >= 0.5]
    for mode in ("avg", "min", "max"):
        want = []
        for img in (0, 1):
            mine = [(rid, kind, box) for i, rid, kind, box in fit if i == img]
            want += [(img, *m) for m in region_merge.merge_rows(mine, mode, 0.5, 8, 1.2)]
        monkeypatch.setattr(regions, "PART_ROWS", 20)
        got = [(r.img, r.rid, r.kind, tuple(r.r), r.n) for r in regions.merge_regions(table(spark, rows), mode).collect()]
        assert sorted(got) == sorted(want)


def test_merge_rules(spark):
    far = [(1, 1, "f", (0, 0, 20, 20)), (1, 2, "f", (100, 100, 20, 20))]
    got = regions.merge_regions(table(spark, far)).collect()
    assert len(got) == 2
    close = [(1, 1, "f", (0, 0, 20, 20)), (1, 2, "f", (2, 2, 20, 20))]
    for mode, box in (("avg", (1, 1, 20, 20)), ("min", (2, 2, 18, 18)), ("max", (0, 0, 22, 22))):
        assert tuple(regions.merge_regions(table(spark, close), mode).first().r) == box
    mixed = [(1, 1, "p", (0, 0, 20, 20)), (1, 2, "f", (2, 2, 20, 20))]
    assert [r.rid for r in regions.merge_regions(table(spark, mixed)).collect()] == [2]


def test_simple_merge_equals_the_sequential_one(spark):
    rows = boxes(90, images=3, seed=6, spread=50)
    want = {}
    for img in range(3):
        faces = [(r[1], r[3]) for r in sorted(rows) if r[0] == img and r[2] == "f"]
        profiles = [(r[1], r[3]) for r in sorted(rows) if r[0] == img and r[2] == "p"]
        inside = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[0] + a[2] <= b[0] + b[2] and a[1] + a[3] <= b[1] + b[3]
        for rid, f in faces:
            for p in profiles:
                c = overlap(f, p[1])
                if inside(p[1], f) or inside(f, p[1]) or c / ((f[2] * f[3] + p[1][2] * p[1][3]) / 2) > 0.25:
                    if not inside(p[1], f):
                        x, y = min(f[0], p[1][0]), min(f[1], p[1][1])
                        f = (x, y, max(f[0] + f[2], p[1][0] + p[1][2]) - x, max(f[1] + f[3], p[1][1] + p[1][3]) - y)
                    profiles.remove(p)
                    break
            want[img, rid] = f
        want.update({(img, rid): p for rid, p in profiles})
    got = regions.merge_pairs_simple(table(spark, rows)).collect()
    assert {(r.img, r.rid): tuple(r.r) for r in got} == want


def test_cascade_counts_children(spark):
    subs = "img bigint, parent bigint, rid bigint, kind string, r struct<x: int, y: int, w: int, h: int>"
    gs = spark.createDataFrame([(1, 1, 11, "i", (2, 2, 10, 10)), (1, 3, 31, "i", (42, 42, 10, 10))], subs)
    fs = spark.createDataFrame([(1, 1, 11, "i", (3, 3, 10, 10)), (1, 3, 31, "m", (62, 62, 10, 10))], subs)
    got = evaluate.region_counts_cascade(table(spark, GIVEN), table(spark, FOUND), gs, fs, 0.5, 0.5, 8).first()
    # Two pairs at the top (1 and 0.5), one child of a pair; all children count as given or found.
    assert (got.match, got.found, got.given) == (2.5, 5, 5)


def test_component_boxes(spark):
    cells = [("a", x, y) for x in range(5) for y in range(2)] + [("a", 7, 0), ("a", 7, 1), ("a", 8, 2), ("b", 0, 0)]
    got = likelihood.component_boxes(spark.createDataFrame(cells, "map string, x int, y int"), 20).collect()
    assert sorted((r.map, r.x, r.y, r.w, r.h, r.n) for r in got) == [
        ("a", 0, 0, 5, 2, 10), ("a", 7, 0, 1, 2, 2), ("a", 8, 2, 1, 1, 1), ("b", 0, 0, 1, 1, 1)]


def test_turns_come_back(spark):
    df = table(spark, boxes(40)).withColumn("p", F.col("rid") % 4)
    odd = F.col("p").isin(1, 3)
    w, h = F.when(odd, 200).otherwise(120), F.when(odd, 120).otherwise(200)
    back = rects.unturn(rects.turn(F.col("r"), F.col("p"), w, h), F.col("p"), w, h)
    assert df.filter(back != F.col("r")).isEmpty()


TREE = "r struct<x: int, y: int, w: int, h: int, subs: array<struct<kind: string, x: int, y: int, w: int, h: int>>>"


def tree(spark, subs):
    return spark.createDataFrame([((10, 20, 40, 40, subs),)], TREE)


def boxed(r):
    return (r.x, r.y, r.w, r.h), None if r.subs is None else [(s.kind, s.x, s.y, s.w, s.h) for s in r.subs]


@pytest.mark.parametrize("change, expected", [
    (lambda r: rects.stretch_all(r, 2), ((-10, 0, 80, 80), [("i", 20, 20, 20, 20), ("n", 45, 45, 20, 20)])),
    (lambda r: rects.stretch_all(r, 2, recurse=False), ((-10, 0, 80, 80), [("i", 25, 25, 10, 10), ("n", 50, 50, 10, 10)])),
    (lambda r: rects.scale_all(r, 0.5), ((5, 10, 20, 20), [("i", 2, 2, 5, 5), ("n", 15, 15, 5, 5)])),
    (lambda r: rects.clip_all(r, rects.rect(*map(F.lit, (12, 22, 25, 25)))), ((12, 22, 25, 25), [("i", 3, 3, 10, 10)])),
    (lambda r: rects.clip_all(r, rects.rect(*map(F.lit, (100, 100, 5, 5)))), ((0, 0, 0, 0), [])),
    (lambda r: rects.rotate_all(r, [[1.0, 0.0, 7.0], [0.0, 1.0, 0.0]]), ((17, 20, 40, 40), [("i", 5, 5, 10, 10), ("n", 30, 30, 10, 10)])),
    (lambda r: rects.turn_all(r, 2, F.lit(100), F.lit(100)), ((50, 40, 40, 40), [("i", 25, 25, 10, 10), ("n", 0, 0, 10, 10)])),
])
def test_children_follow_their_region(spark, change, expected):
    made = tree(spark, [("i", 5, 5, 10, 10), ("n", 30, 30, 10, 10)]).select(change(F.col("r")).alias("r")).first().r
    assert boxed(made) == expected


@pytest.mark.parametrize("subs", [None, []])
def test_regions_without_children(spark, subs):
    r = F.col("r")
    for change in (rects.stretch_all(r, 2), rects.scale_all(r, 2), rects.affine_all(r, [[1.0, 0, 0], [0, 1.0, 0]]),
                   rects.clip_all(r, rects.rect(*map(F.lit, (0, 0, 99, 99)))), rects.turn_all(r, 1, F.lit(99), F.lit(99))):
        assert boxed(tree(spark, subs).select(change.alias("r")).first().r)[1] == subs
