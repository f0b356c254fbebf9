"""Class-likelihood models: histograms, Gaussian, ensembles, and scores over regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.operators.components import connected_components
from simloom.operators.regions import GRID, _tiled
from simloom.session import cut

BROADCAST_CELLS = 1 << 18
AXES = ("i", "j", "k")


def bin_of(x: Column, bins: int) -> Column:
    return F.floor(x * (bins - 1)).cast("int")


def _binned(points: DataFrame, dims: tuple[str, str, str], bins: int) -> DataFrame:
    out = points
    for axis, d in zip(AXES, dims):
        out = out.withColumn(axis, bin_of(F.col(d), bins))
    return out


def _model(df: DataFrame, cells: int) -> DataFrame:
    """A cube is bounded by its bins: small ones are broadcast, others joined by shuffle."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def fit_cube(points: DataFrame, dims: tuple[str, str, str], bins: int) -> DataFrame:
    """(i, j, k, v): counts of points in [0, 1]^3."""
    return _binned(points, dims, bins).groupBy(*AXES).agg(F.count("*").alias("v"))


def normalise_cube(cube: DataFrame, bins: int) -> DataFrame:
    """Interior cells become the mean of themselves and their six neighbours, all cells then
    divide by the largest value before smoothing."""
    top = cube.agg(F.max("v")).first()[0]
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    moves = F.explode(F.array(*[
        F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(AXES, s)], F.lit(int(s == (0, 0, 0))).alias("own"))
        for s in steps
    ]))
    spread = cube.select("v", moves.alias("c")).select("c.*", "v")
    inside = F.lit(True)
    valid = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) > 0) & (F.col(a) < bins - 1)
        valid = valid & (F.col(a) >= 0) & (F.col(a) < bins)
    sums = spread.filter(valid).groupBy(*AXES).agg(
        F.sum("v").alias("_all"), F.sum(F.col("v") * F.col("own")).alias("_own")
    )
    v = F.when(inside, F.col("_all") / 7).otherwise(F.col("_own")) / F.lit(top)
    return sums.select(*AXES, v.alias("v")).filter("v > 0")


def fit_marginals(points: DataFrame, dims: tuple[str, str, str], bins: int) -> DataFrame:
    """(dim, bin, v): per-dimension counts over max(1, largest count)."""
    rows = points.select(F.posexplode(F.array(*dims)).alias("dim", "x")).groupBy(
        "dim", bin_of(F.col("x"), bins).alias("bin")
    ).agg(F.count("*").alias("n"))
    top = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.max("n")).alias("_t"))
    return rows.join(F.broadcast(top), "dim").select("dim", "bin", (F.col("n") / F.col("_t")).alias("v"))


def score_cube(points: DataFrame, cube: DataFrame, dims: tuple[str, str, str], bins: int, name: str = "score") -> DataFrame:
    """Likelihood of each point: its cell of the cube, 0 for an empty one."""
    met = _binned(points, dims, bins).join(_model(cube, bins**3), list(AXES), "left")
    return met.withColumn(name, F.coalesce("v", F.lit(0.0))).drop("v", *AXES)


def score_marginals(points: DataFrame, marginals: DataFrame, dims: tuple[str, str, str], bins: int) -> DataFrame:
    """Cube root of the product of the three marginals."""
    out, product = points, F.lit(1.0)
    for n, d in enumerate(dims):
        one = marginals.filter(F.col("dim") == n).select(F.col("bin").alias(f"_b{n}"), F.col("v").alias(f"_v{n}"))
        out = out.withColumn(f"_b{n}", bin_of(F.col(d), bins)).join(_model(one, bins), f"_b{n}", "left")
        product = product * F.coalesce(f"_v{n}", F.lit(0.0))
    extra = [f"_{c}{n}" for n in range(3) for c in "bv"]
    return out.withColumn("score", F.pow(product, F.lit(1 / 3))).drop(*extra)


def bayes_cube(given: DataFrame, other: DataFrame) -> DataFrame:
    """(i, j, k, p): p(s|c) from the counts of a class and of its complement."""
    s, n = given.withColumnRenamed("v", "_s"), other.withColumnRenamed("v", "_n")
    both = s.join(n, list(AXES), "full")
    ts, tn = (F.lit(df.agg(F.sum("v")).first()[0]) for df in (given, other))
    prior = ts / (ts + tn)
    in_s = F.coalesce("_s", F.lit(0)) / ts * prior
    in_n = F.coalesce("_n", F.lit(0)) / tn * (1 - prior)
    return both.select(*AXES, (in_s / (in_s + in_n)).alias("p"))


def fit_gauss(points: DataFrame, dims: tuple[str, str, str]) -> DataFrame:
    """One row: means m0..m2 and population covariances c00..c22, in one pass."""
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    return points.agg(
        *[F.avg(d).alias(f"m{n}") for n, d in enumerate(dims)],
        *[F.covar_pop(dims[a], dims[b]).alias(f"c{a}{b}") for a, b in pairs],
    )


def score_gauss(points: DataFrame, model: DataFrame, dims: tuple[str, str, str], div: float = 4.0) -> DataFrame:
    """exp(-v' inv(C) v / div); the 3 x 3 matrix is inverted on the driver and becomes literals."""
    m = model.first()
    cov = np.array([[m[f"c{min(a, b)}{max(a, b)}"] for b in range(3)] for a in range(3)])
    inv = np.linalg.pinv(cov)
    v = [F.col(d) - F.lit(m[f"m{n}"]) for n, d in enumerate(dims)]
    z = sum(float(inv[a, b]) * v[a] * v[b] for a in range(3) for b in range(3))
    return points.withColumn("score", F.exp(-z / F.lit(div)))


def ensemble(scores: dict[str, float]) -> Column:
    """Weighted mean of score columns; weights are normalised, zero ones left out."""
    used = {c: w for c, w in scores.items() if w}
    total = sum(scores.values()) or 1.0
    return sum(F.lit(w / total) * F.col(c) for c, w in used.items())


def above(score: Column, t: float) -> Column:
    return F.when(score >= t, 1).otherwise(0)


def region_mean(regions: DataFrame, points: DataFrame, min_mean: float, subs: Column, min_dim: int = 16,
                min_dim_two: int = 8, grid: int = GRID) -> DataFrame:
    """Regions whose points (img, px, py, score) average at least ``min_mean``.

    Regions large enough that have sub-regions (or, when smaller, at least two) are kept anyway.
    """
    at = points.withColumn("tx", F.floor(F.col("px") / grid)).withColumn("ty", F.floor(F.col("py") / grid))
    means = (
        _tiled(regions.select("img", "rid", "r"), grid)
        .join(at, ["img", "tx", "ty"])
        .filter(rects.contains_point(F.col("r"), F.col("px"), F.col("py")))
        .groupBy("img", "rid")
        .agg(F.avg("score").alias("mean"))
    )
    size = rects.diameter(F.col("r"))
    exempt = ((size >= min_dim) & (subs > 0)) | ((size >= min_dim_two) & (subs > 1))
    return (
        regions.join(means, ["img", "rid"], "left")
        .withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        .filter(exempt | (F.col("mean") >= min_mean))
    )


def component_boxes(cells: DataFrame, width: int) -> DataFrame:
    """Bounding boxes of 4-connected cells (map, x, y) per map: (map, comp, x, y, w, h, n).

    ``width`` is the grid's width; a cell's number is y * width + x, and a component has the number
    of its first cell. Rows of a map are cut into runs first (at most ``width`` cells share a
    window), and runs that touch are connected: long runs keep the graph small. There is no limit
    on the number of components.
    """
    x = F.col("x")
    w = Window.partitionBy("map", "y").orderBy("x")
    island = (x - F.row_number().over(w)).alias("_i")
    runs = cells.select("map", "y", "x", island).withColumn(
        "_x0", F.min("x").over(Window.partitionBy("map", "y", "_i"))
    )
    number = F.col("y").cast("bigint") * width + F.col("_x0")
    placed = cut(runs.select("map", "y", "x", F.struct("map", number.alias("n")).alias("node")))
    below = placed.select("map", (F.col("y") - 1).alias("y"), "x", F.col("node").alias("b"))
    edges = placed.join(below, ["map", "y", "x"]).select(F.col("node").alias("a"), "b")
    comps = connected_components(edges)
    whole = placed.groupBy("node").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("y").alias("y"), F.count("*").alias("n")
    )
    met = whole.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return met.groupBy("component").agg(
        F.min("x0").alias("x"), F.min("y").alias("y0"), (F.max("x1") - F.min("x0") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"), F.sum("n").alias("cells"),
    ).select(
        F.col("component.map").alias("map"), F.col("component.n").alias("comp"), "x", F.col("y0").alias("y"), "w", "h",
        F.col("cells").alias("n"),
    )
