"""Likelihood models on line items scaled to [0, 1]^3."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.scalars import rounded
from simloom.operators import likelihood
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, boxes

BINS = 8
DIMS = ("a", "b", "c")
_P = (
    "p AS (SELECT l_orderkey AS img, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag, "
    "l_quantity / 50 AS a, abs(l_discount) * 10 AS b, abs(l_tax) * 12.5 AS c FROM lineitem), "
    "g AS (SELECT *, CAST(floor(a * 7) AS BIGINT) AS i, CAST(floor(b * 7) AS BIGINT) AS j, CAST(floor(c * 7) AS BIGINT) AS k FROM p)"
)
_CUBE = _P + ", cb AS (SELECT i, j, k, count(*) AS v FROM g GROUP BY ALL)"
_INSIDE = "i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6 AND k BETWEEN 1 AND 6"
_NORM = (
    _CUBE + ", mv AS (SELECT i + x AS i, j + y AS j, k + z AS k, v, x = 0 AND y = 0 AND z = 0 AS own FROM cb, "
    "(VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(x, y, z)), "
    "nc AS (SELECT i, j, k, CASE WHEN " + _INSIDE + " THEN sum(v) / 7.0::DOUBLE ELSE sum(CASE WHEN own THEN v ELSE 0 END)::DOUBLE END AS v FROM mv "
    "WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 7 GROUP BY i, j, k), nz AS (SELECT i, j, k, v / t AS v FROM nc, (SELECT max(v) AS t FROM cb) WHERE v > 0)"
)
_MARG = (
    _P + ", d AS (SELECT 0 AS dim, i AS bin FROM g UNION ALL SELECT 1, j FROM g UNION ALL SELECT 2, k FROM g), "
    "dn AS (SELECT dim, bin, count(*) AS n FROM d GROUP BY ALL), "
    "mg AS (SELECT dim, bin, n / greatest(1, max(n) OVER (PARTITION BY dim)) AS v FROM dn)"
)
KEYS = ("img", "line", "part", "supp")


def points(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") / 50).alias("a"), (F.abs("l_discount") * 10).alias("b"), (F.abs("l_tax") * 12.5).alias("c"),
    )


def wide(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in "ijk"], *[c for c in df.columns if c not in "ijk"])


def cube(spark, sf):
    return likelihood.fit_cube(points(spark, sf), DIMS, BINS)


def model(spark, sf):
    return likelihood.normalise_cube(cube(spark, sf), BINS)


def _scores(df, name="score"):
    return df.select(*KEYS, rounded(F.col(name)).alias(name))


_KEYS = "img, CAST(line AS BIGINT) AS line, part, supp"


@query("hist3d_fit", f"WITH {_CUBE} SELECT i, j, k, CAST(v AS BIGINT) AS v FROM cb")
def hist3d_fit(spark, sf):
    return wide(cube(spark, sf))


@query("hist3d_normalise", f"WITH {_NORM} SELECT i, j, k, round(v, 6) AS v FROM nz")
def hist3d_normalise(spark, sf):
    return wide(model(spark, sf).withColumn("v", rounded(F.col("v"))))


@query("hist1d_fit", f"WITH {_MARG} SELECT CAST(dim AS BIGINT) AS dim, bin, round(v, 6) AS v FROM mg")
def hist1d_fit(spark, sf):
    m = likelihood.fit_marginals(points(spark, sf), DIMS, BINS)
    return m.select(F.col("dim").cast("bigint").alias("dim"), F.col("bin").cast("bigint").alias("bin"), rounded(F.col("v")).alias("v"))


@query("hist3d_score", f"WITH {_NORM} SELECT {_KEYS}, round(coalesce(nz.v, 0), 6) AS score FROM g LEFT JOIN nz USING (i, j, k)")
def hist3d_score(spark, sf):
    return _scores(likelihood.score_cube(points(spark, sf), model(spark, sf), DIMS, BINS))


@query("hist1d_score",
       f"WITH {_MARG} SELECT {_KEYS}, round(pow(x.v * y.v * z.v, 1 / 3), 6) AS score FROM g JOIN mg x ON x.dim = 0 AND x.bin = i "
       "JOIN mg y ON y.dim = 1 AND y.bin = j JOIN mg z ON z.dim = 2 AND z.bin = k")
def hist1d_score(spark, sf):
    p = points(spark, sf)
    return _scores(likelihood.score_marginals(p, likelihood.fit_marginals(p, DIMS, BINS), DIMS, BINS))


@query("bayes_score",
       f"WITH {_P}, t AS (SELECT i, j, k, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS s, sum(CASE WHEN flag = 'R' THEN 0 ELSE 1 END) AS n FROM g GROUP BY ALL), "
       "u AS (SELECT sum(s) AS ts, sum(n) AS tn FROM t) SELECT i, j, k, round((s / ts * (ts / (ts + tn))) / (s / ts * (ts / (ts + tn)) + n / tn * (1 - ts / (ts + tn))), 6) AS p FROM t, u")
def bayes_score(spark, sf):
    p = points(spark, sf)
    cubes = [likelihood.fit_cube(p.filter(c), DIMS, BINS) for c in (F.col("flag") == "R", F.col("flag") != "R")]
    return wide(likelihood.bayes_cube(*cubes).withColumn("p", rounded(F.col("p"))))


_COVS = [(x, y) for n, x in enumerate("abc") for y in "abc"[n:]]
_GAUSS = (
    _P + ", gm AS (SELECT " + ", ".join(f"avg({x}) AS m{n}" for n, x in enumerate("abc")) + ", "
    + ", ".join(f"covar_pop({x}, {y}) AS c{'abc'.index(x)}{'abc'.index(y)}" for x, y in _COVS) + " FROM p)"
)


@query("gauss_fit", f"WITH {_GAUSS} SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in ("m0", "m1", "m2", "c00", "c01", "c02", "c11", "c12", "c22")) + " FROM gm")
def gauss_fit(spark, sf):
    m = likelihood.fit_gauss(points(spark, sf), DIMS)
    return m.select(*[rounded(F.col(c)).alias(c) for c in m.columns])


# Inverse of a symmetric 3 x 3 matrix by cofactors.
_INV = (
    _GAUSS + ", iv AS (SELECT *, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS det FROM gm), "
    "z AS (SELECT img, line, part, supp, a - m0 AS x, b - m1 AS y, c - m2 AS w, (c11 * c22 - c12 * c12) / det AS i00, (c02 * c12 - c01 * c22) / det AS i01, "
    "(c01 * c12 - c02 * c11) / det AS i02, (c00 * c22 - c02 * c02) / det AS i11, (c01 * c02 - c00 * c12) / det AS i12, (c00 * c11 - c01 * c01) / det AS i22 FROM p, iv), "
    "gs AS (SELECT img, line, part, supp, exp(-(i00 * x * x + i11 * y * y + i22 * w * w + 2 * (i01 * x * y + i02 * x * w + i12 * y * w)) / 4) AS score FROM z)"
)


@query("gauss_score", f"WITH {_INV} SELECT {_KEYS}, round(score, 6) AS score FROM gs")
def gauss_score(spark, sf):
    p = points(spark, sf)
    return _scores(likelihood.score_gauss(p, likelihood.fit_gauss(p, DIMS), DIMS))


_ENSEMBLE = (
    _NORM + ", " + _INV[len(_P) + 2:] + ", en AS (SELECT g.img, g.line, g.part, g.supp, 0.25 * coalesce(nz.v, 0) + 0.75 * gs.score AS score "
    "FROM g LEFT JOIN nz USING (i, j, k) JOIN gs ON gs.img = g.img AND gs.line = g.line AND gs.part = g.part AND gs.supp = g.supp)"
)


def combined(spark, sf):
    p = points(spark, sf)
    with_cube = likelihood.score_cube(p, model(spark, sf), DIMS, BINS, name="cube")
    both = likelihood.score_gauss(with_cube, likelihood.fit_gauss(p, DIMS), DIMS).withColumnRenamed("score", "gauss")
    unused = both.withColumn("other", F.lit(0.5))
    return unused.withColumn("score", likelihood.ensemble({"cube": 0.5, "gauss": 1.5, "other": 0.0}))


@query("score_ensemble", f"WITH {_ENSEMBLE} SELECT {_KEYS}, round(score, 6) AS score FROM en")
def score_ensemble(spark, sf):
    return _scores(combined(spark, sf))


@query("score_threshold", f"WITH {_ENSEMBLE} SELECT {_KEYS}, CAST(CASE WHEN round(score, 6) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS hit FROM en")
def score_threshold(spark, sf):
    return combined(spark, sf).select(*KEYS, likelihood.above(rounded(F.col("score")), 0.5).cast("bigint").alias("hit"))


@query("score_region_mean",
       f"WITH {BOXES}, pt AS (SELECT l_orderkey AS img, l_partkey % 200 AS px, l_suppkey % 100 AS py, abs(l_discount) * 10 AS score FROM lineitem), "
       "m AS (SELECT b.img, b.rid, any_value(greatest(w, h)) AS size, avg(pt.score) AS mean FROM b LEFT JOIN pt ON pt.img = b.img AND px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY ALL) "
       "SELECT img, rid, round(mean, 6) AS mean FROM m WHERE (size >= 50 AND rid % 3 > 0) OR (size >= 30 AND rid % 3 > 1) OR mean >= 0.6")
def score_region_mean(spark, sf):
    t = table(spark, sf, "lineitem")
    pts = t.select(
        F.col("l_orderkey").alias("img"), (F.col("l_partkey") % 200).alias("px"), (F.col("l_suppkey") % 100).alias("py"),
        (F.abs("l_discount") * 10).alias("score"),
    )
    kept = likelihood.region_mean(boxes(spark, sf), pts, 0.6, F.col("rid") % 3, min_dim=50, min_dim_two=30)
    return kept.select("img", "rid", rounded(F.col("mean")).alias("mean"))


# Cells of three maps (one per return flag) that hold at least two expensive lines.
_CELLS = (
    "q AS (SELECT l_returnflag AS map, l_partkey % 200 AS x, l_suppkey % 100 AS y FROM lineitem GROUP BY ALL "
    "HAVING count(*) >= 2), r AS (SELECT map, x, y, y * 200 + x AS id, y * 200 + x AS low FROM q UNION SELECT q.map, q.x, q.y, q.y * 200 + q.x, r.low FROM r JOIN q "
    "ON q.map = r.map AND abs(q.x - r.x) + abs(q.y - r.y) = 1 AND r.low < q.y * 200 + q.x), "
    "c AS (SELECT map, x, y, min(low) AS comp FROM r GROUP BY ALL)"
)


@query("score_components",
       f"WITH RECURSIVE {_CELLS} SELECT map, comp, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL")
def score_components(spark, sf):
    cells = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("map"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 100).alias("y"))
        .count()
        .filter("count >= 2")
        .drop("count")
    )
    return likelihood.component_boxes(cells, 200)
