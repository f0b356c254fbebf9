"""Ranked lists: order, trim, merge and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import rects, scalars
from simloom.operators import ranking, regions, similarity
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, as_queries, boxes, centroid_hits, centroids, items, neighbours
from simloom.session import cut

COLS = ("query_id", "item_id", "dist")


def hits(spark, sf, **how):
    return similarity.search(centroids(spark, sf), items(spark, sf), **how)


@query("rank_asc",
       f"WITH {centroid_hits()} SELECT qid AS query_id, iid AS item_id, d AS dist, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM h")
def rank_asc(spark, sf):
    return similarity.ranked(hits(spark, sf).select(*COLS))


@query("best",
       f"WITH {neighbours(1)} SELECT qid AS query_id, iid AS item_id, d AS dist FROM n")
def best(spark, sf):
    x = items(spark, sf)
    return ranking.best(similarity.search(as_queries(x), x, top_n=1, skip="id"))


_TRIMS = {"-1": "true", "0": "d = 0", "0.95": "d <= 0.95", "3": "r <= 3", "20.99": "d <= 0.99 AND r <= 20"}


@query("trim",
       f"WITH {neighbours(25, True)}, z AS (SELECT qid, iid, d, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS r FROM n) "
       + " UNION ALL ".join(f"SELECT '{t}' AS t, qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM z WHERE {c}" for t, c in _TRIMS.items())
       + " UNION ALL SELECT 'skip', qid, iid, d, row_number() OVER (PARTITION BY qid ORDER BY d, iid) FROM n WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, iid) <= 3")
def trim(spark, sf):
    x = items(spark, sf)
    found = cut(similarity.search(as_queries(x), x, top_n=25).select(*COLS))
    parts = [ranking.trim(found, float(t)).withColumn("t", F.lit(t)) for t in _TRIMS]
    parts.append(ranking.trim(found, 3, skip_zero=True).withColumn("t", F.lit("skip")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("trim_each",
       f"WITH {centroid_hits()}, z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS r FROM h) "
       "SELECT qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM z WHERE (qid % 3 = 0 OR r <= qid * 3) AND (qid % 2 = 0 OR d <= 0.9 + qid * 0.02)")
def trim_each(spark, sf):
    q = F.col("query_id")
    own = centroids(spark, sf).select(
        "query_id", F.when(q % 3 != 0, q * 3).alias("top_n"), F.when(q % 2 != 0, F.lit(0.9) + q * F.lit(0.02)).alias("max_dist")
    )
    return ranking.trim_each(hits(spark, sf).select(*COLS), own)


def bucket_hits(spark, sf, k):
    """Top-k of each query from each of eight item buckets, as separate rankings."""
    x = items(spark, sf).withColumn("by", F.col("item_id") % 8)
    q = centroids(spark, sf).withColumn("by", F.explode(F.array(*map(F.lit, range(8)))))
    return similarity.search(q, x, top_n=k)


@query("merge_topk",
       f"WITH {centroid_hits()} SELECT qid AS query_id, iid AS item_id, d AS dist, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM h QUALIFY rank <= 10")
def merge_topk(spark, sf):
    parts = bucket_hits(spark, sf, 10).select(*COLS)
    # A hit may come back from two buckets; the merge keeps it once.
    return ranking.merge_top_k(parts.unionByName(parts), 10)


@query("result_limit",
       "SELECT c_custkey, CASE WHEN c_nationkey / 10.0 + c_custkey % 3 >= 1 THEN CAST(floor(c_nationkey / 10.0 + c_custkey % 3) AS BIGINT) END AS row_limit FROM customer")
def result_limit(spark, sf):
    t = F.col("c_nationkey") / 10.0
    return table(spark, sf, "customer").select(
        "c_custkey", scalars.result_limit(t, F.col("c_custkey") % 3).alias("row_limit")
    )


@query("topk_total",
       f"WITH {centroid_hits()} SELECT qid AS query_id, iid AS item_id, d AS dist, CAST(count(*) OVER (PARTITION BY qid) AS BIGINT) AS total, "
       "row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM h WHERE d <= 1 QUALIFY rank <= 7")
def topk_total(spark, sf):
    return ranking.top_k_with_total(hits(spark, sf, max_dist=1.0).select(*COLS), 7)


_CENTRAL = (
    "c AS (SELECT *, -CAST(floor(ln(CAST(greatest(w, h) AS DOUBLE)) / ln(4 / 3)) AS BIGINT) AS s, "
    "round(sqrt(pow(CAST(round_even(x + w * 0.5, 0) AS BIGINT) - 129, 2) + pow(CAST(round_even(y + h * 0.5, 0) AS BIGINT) - 62, 2)), 6) AS f FROM b), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY s, f, kind, rid) AS rank FROM c)"
)


@query("order_regions", f"WITH {BOXES}, {_CENTRAL} SELECT img, rid, rank FROM o")
def order_regions(spark, sf):
    return regions.central_order(boxes(spark, sf), 258, 125).select("img", "rid", "rank")


@query("primary_region",
       f"WITH {BOXES}, {_CENTRAL} SELECT img, rid FROM o WHERE kind = 'f' QUALIFY row_number() OVER (PARTITION BY img ORDER BY rank) = 1")
def primary_region(spark, sf):
    return regions.primary_region(regions.central_order(boxes(spark, sf), 258, 125), ("f",))


@query("prime_region",
       f"WITH {BOXES}, {_CENTRAL}, p AS (SELECT o_orderkey AS img, o_orderkey % 200 AS px, o_custkey % 100 AS py FROM orders) "
       "SELECT o.img, rid, row_number() OVER (PARTITION BY o.img ORDER BY CASE WHEN kind IN ('f', 'p', 'u') AND px >= x AND px < x + w AND py >= y AND py < y + h THEN 0 ELSE 1 END, rank) AS new_rank "
       "FROM o LEFT JOIN p ON o.img = p.img")
def prime_region(spark, sf):
    points = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("img"), (F.col("o_orderkey") % 200).alias("px"), (F.col("o_custkey") % 100).alias("py")
    )
    ordered = regions.central_order(boxes(spark, sf), 258, 125)
    return regions.prime_region(ordered, points).select("img", "rid", "new_rank")


def landmarks(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, "nmie")), (F.col("rid") % 4 + 1).cast("int"))
    return boxes(spark, sf).withColumn("kind", kind)


_MARKS = "k AS (SELECT * REPLACE (['n', 'm', 'i', 'e'][rid % 4 + 1] AS kind) FROM b)"


@query("cap_subregions",
       f"WITH {BOXES}, {_MARKS} SELECT img, kind, rid FROM k QUALIFY row_number() OVER (PARTITION BY img, kind ORDER BY "
       "abs(x - 100) * CASE WHEN kind IN ('n', 'm') THEN 1 ELSE -1 END, rid) <= CASE WHEN kind IN ('n', 'm') THEN 1 ELSE 2 END")
def cap_subregions(spark, sf):
    off = F.abs(F.col("r.x") - 100) * F.when(F.col("kind").isin("n", "m"), 1).otherwise(-1)
    return regions.cap_per_kind(landmarks(spark, sf), {"n": 1, "m": 1, "i": 2, "e": 2}, [off, F.col("rid")]).select("img", "kind", "rid")


@query("keep_extremes",
       f"WITH {BOXES}, {_MARKS} SELECT img, first(rid ORDER BY x, rid) AS leftmost, first(rid ORDER BY x DESC, rid) AS rightmost FROM k WHERE kind = 'i' GROUP BY img")
def keep_extremes(spark, sf):
    return regions.keep_extremes(landmarks(spark, sf), "i")


@query("first_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)
