"""Each extension point used with an entry of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from simloom.functions.scalars import rounded
from simloom.operators import evaluate, registry, similarity, tune
from simloom.plans.aggregates import SLICE_HITS, slice_hits
from simloom.plans.catalogue import query, table
from simloom.plans.evaluation import PRF, _PAIRS, prf_sql
from simloom.plans.inputs import BOXES, CENTROIDS, E, boxes, centroids, items
from simloom.plans.likelihood import _KEYS, _P, KEYS, points


@query("register_metric",
       f"WITH {CENTROIDS} SELECT c.id AS query_id, e.id AS item_id, round(list_max(list_transform(list_zip(c.v, e.v), lambda t: abs(t[1] - t[2]))), 6) AS dist FROM c, e "
       "WHERE round(list_max(list_transform(list_zip(c.v, e.v), lambda t: abs(t[1] - t[2]))), 6) <= 0.3")
def register_metric(spark, sf):
    def block(q, x):
        out = np.zeros((len(q), len(x)))
        for j in range(q.shape[1]):
            np.maximum(out, np.abs(q[:, j, None] - x[None, :, j]), out=out)
        return out

    registry.register_metric(
        "chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda s, t: F.abs(s - t))), block, triangle=True, replace=True
    )
    hits = similarity.search(centroids(spark, sf), items(spark, sf), metric="chebyshev", max_dist=0.3)
    return hits.select("query_id", "item_id", "dist")


@query("register_fusion",
       f"WITH {SLICE_HITS} SELECT qid AS query_id, iid AS item_id, min(d) AS dist FROM w GROUP BY ALL")
def register_fusion(spark, sf):
    registry.register_fusion(
        "nearest", lambda hits, weights: hits.groupBy("query_id", "item_id").agg(F.min("dist").alias("dist")), replace=True
    )
    combine = registry.FUSIONS.get("nearest")
    return combine(slice_hits(spark, sf), {})


@query("register_variant",
       f"WITH {E} SELECT id AS item_id, 'half' AS variant, round(list_sum(v[1:32]), 6) AS total FROM e UNION ALL SELECT id, 'back', round(v[64] - v[1], 6) FROM e")
def register_variant(spark, sf):
    @udtf(returnType="variant string, vec array<double>", useArrow=True)
    class Variants:
        def eval(self, item_id: int, vec: list):
            yield "half", vec[:32]
            yield "back", [vec[-1], -vec[0]]

    registry.register_variant(spark, "item_variants", Variants, replace=True)
    items(spark, sf).createOrReplaceTempView("variant_items")
    out = spark.sql("SELECT i.item_id, v.variant, v.vec FROM variant_items i, LATERAL item_variants(i.item_id, i.vec) v")
    total = F.aggregate("vec", F.lit(0.0), lambda a, t: a + t)
    return out.select("item_id", "variant", rounded(total).alias("total"))


@query("register_predicate", f"WITH {BOXES} SELECT img, rid FROM b WHERE w > 2 * h")
def register_predicate(spark, sf):
    registry.register_predicate("wide", lambda r: r["w"] > 2 * r["h"], replace=True)
    return boxes(spark, sf).filter(registry.PREDICATES.get("wide")(F.col("r"))).select("img", "rid")


@query("register_objective",
       f"WITH {_PAIRS}, bs AS (SELECT bin, sum(same) OVER (ORDER BY bin) AS match, sum(same + other) OVER (ORDER BY bin) AS found FROM b), "
       "bf AS (SELECT bin, " + prf_sql("match", "found", "given") + " FROM bs, gv) SELECT round(bin / 1000000.0, 6)::DOUBLE AS t, recall AS best FROM bf WHERE precision >= 0.095 ORDER BY recall DESC, bin DESC LIMIT 1")
def register_objective(spark, sf):
    registry.register_objective(
        "recall_at_precision", lambda sweep: sweep.filter("precision >= 0.095").withColumn("f", F.col("recall")), replace=True
    )
    x = items(spark, sf)
    sweep = tune.running_prf(evaluate.pair_counts(x), "bin", evaluate.given_pairs(x))
    best = tune.best_row(registry.OBJECTIVES.get("recall_at_precision")(sweep), "bin")
    return best.select(rounded(F.col("t") / 10**evaluate.RESOLUTION).alias("t"), F.col("f").alias("best"))


@query("register_model",
       f"WITH {_P} SELECT {_KEYS}, round(1 / (1 + exp(-(2 * a - b + c - 1))), 6) AS score FROM p")
def register_model(spark, sf):
    registry.register_model(
        "logistic", lambda df: 1 / (1 + F.exp(-(2 * df["a"] - df["b"] + df["c"] - 1))), replace=True
    )
    p = points(spark, sf)
    return p.withColumn("score", rounded(registry.MODELS.get("logistic")(p))).select(*KEYS, "score")
