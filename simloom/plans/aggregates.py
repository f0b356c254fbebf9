"""Counts, groupings, fusion of rankings, histograms and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import vectors
from simloom.functions.scalars import rounded
from simloom.operators import aggregates, fusion, ranking, similarity
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import (
    CENTROIDS,
    SLICED,
    SLICES,
    SLICE_WEIGHTS,
    as_queries,
    centroid_hits,
    centroids,
    items,
    slices,
    unit,
)

WEIGHTS = dict(zip(SLICES, SLICE_WEIGHTS))


@query("count_items", "SELECT CAST(count(*) AS BIGINT) AS n, count(*) = 0 AS empty FROM embeddings")
def count_items(spark, sf):
    return items(spark, sf).agg(F.count("*").alias("n"), (F.count("*") == 0).alias("empty"))


@query("group_sizes", "SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY ALL")
def group_sizes(spark, sf):
    return aggregates.group_sizes(items(spark, sf))


# The l1 and l2 scores of the same pairs form one list with two scores per id.
@query("min_score_per_id",
       f"WITH {CENTROIDS}, s AS (SELECT c.id AS qid, e.id AS iid, round(list_distance(c.v, e.v), 6) AS d FROM c, e UNION ALL "
       "SELECT c.id, e.id, round(list_sum(list_transform(list_zip(c.v, e.v), lambda t: abs(t[1] - t[2]))), 6) FROM c, e) "
       "SELECT qid AS query_id, iid AS item_id, min(d) AS low, max(d) AS high FROM s GROUP BY ALL")
def min_score_per_id(spark, sf):
    q, x = centroids(spark, sf), items(spark, sf)
    both = similarity.search(q, x).unionByName(similarity.search(q, x, metric="l1"))
    low = ranking.one_score_per_id(both).withColumnRenamed("dist", "low")
    high = ranking.one_score_per_id(both, lowest=False).withColumnRenamed("dist", "high")
    return low.join(high, ["query_id", "item_id"])


def labelled_hits(spark, sf):
    x = items(spark, sf)
    return similarity.search(centroids(spark, sf), x).join(x.select("item_id", "label"), "item_id")


@query("group_nearest",
       f"WITH {centroid_hits()} SELECT qid AS query_id, il AS label, iid AS item_id, d AS dist, "
       "row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM "
       "(SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, il ORDER BY d, iid) = 1)")
def group_nearest(spark, sf):
    return ranking.group_nearest(labelled_hits(spark, sf))


@query("group_median",
       f"WITH {centroid_hits()} SELECT qid AS query_id, il AS label, iid AS item_id, d AS dist FROM h "
       "QUALIFY row_number() OVER (PARTITION BY qid, il ORDER BY d, iid) = count(*) OVER (PARTITION BY qid, il) // 2 + 1")
def group_median(spark, sf):
    return ranking.group_median(labelled_hits(spark, sf))


def slice_hits(spark, sf, k=20):
    """Each item's k nearest by each of the four slice descriptors (itself included)."""
    x = slices(spark, sf)
    return similarity.search(as_queries(x), x, top_n=k, scale=1.0)


_D = unit("list_distance(a.v, b.v)")
SLICE_HITS = (
    SLICED + f", h AS (SELECT a.dt AS dt, a.id AS qid, b.id AS iid, round({_D}, 6) AS d, "
    f"row_number() OVER (PARTITION BY a.dt, a.id ORDER BY round({_D}, 6), b.id) AS r FROM s a JOIN s b ON a.dt = b.dt QUALIFY r <= 20), "
    "w AS (SELECT *, CASE dt WHEN 's1' THEN 0.1 WHEN 's2' THEN 0.3 WHEN 's3' THEN 0.6 ELSE 0.9 END::DOUBLE AS w FROM h)"
)


# The fusion of whole lists: items with an id divisible by 50 ask for all items.
_BEST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) <= 20"
WHOLE = (
    SLICED + f", h AS (SELECT a.dt AS dt, a.id AS qid, b.id AS iid, round({_D}, 6) AS d, "
    f"row_number() OVER (PARTITION BY a.dt, a.id ORDER BY round({_D}, 6), b.id) AS r FROM s a JOIN s b ON a.dt = b.dt WHERE a.id % 50 = 0), "
    "w AS (SELECT *, CASE dt WHEN 's1' THEN 0.1 WHEN 's2' THEN 0.3 WHEN 's3' THEN 0.6 ELSE 0.9 END::DOUBLE AS w FROM h)"
)


def best_fused(spark, sf, how, k=None, **options):
    x = slices(spark, sf).select("item_id", "by", "vec")
    return fusion.top_fused(as_queries(x.filter("item_id % 50 = 0")), x, WEIGHTS, how, k, **options)


@query("fuse_borda",
       f"WITH {WHOLE}, l AS (SELECT qid, max(n) AS len FROM (SELECT qid, dt, count(*) AS n FROM w GROUP BY ALL) GROUP BY qid), "
       "p AS (SELECT qid, iid, sum(w * (len - (r - 1))) AS pts, min(d) AS d FROM w JOIN l USING (qid) GROUP BY ALL), "
       "m AS (SELECT qid, greatest(1.0, max(pts)) + 1 AS m FROM p GROUP BY qid) "
       f"SELECT qid AS query_id, iid AS item_id, round(CASE WHEN d = 0 THEN 0 ELSE (m - pts) / m END, 6) AS dist FROM p JOIN m USING (qid)")
def fuse_borda(spark, sf):
    return best_fused(spark, sf, "borda")


@query("fuse_product",
       f"WITH {WHOLE} SELECT * FROM (SELECT qid AS query_id, iid AS item_id, round(CASE WHEN min(d) = 0 THEN 0 ELSE "
       f"{unit('1.6473 * exp(sum(w * ln(CASE WHEN d > 0 THEN d END)))')} END, 6) AS dist FROM w GROUP BY ALL) {_BEST}")
def fuse_product(spark, sf):
    return best_fused(spark, sf, "product", 20, fused_scale=fusion.PRODUCT_SCALE_MATCHER)


@query("fuse_mean",
       f"WITH {WHOLE} SELECT qid AS query_id, iid AS item_id, round(sum(w * d) / count(*), 9) AS dist FROM w GROUP BY ALL")
def fuse_mean(spark, sf):
    return best_fused(spark, sf, "mean")


@query("fuse_mean_uncut",
       f"WITH {SLICED}, w AS (SELECT a.id AS qid, b.id AS iid, round({_D}, 6) AS d, "
       "CASE a.dt WHEN 's1' THEN 0.1 WHEN 's2' THEN 0.3 WHEN 's3' THEN 0.6 ELSE 0.9 END::DOUBLE AS w "
       "FROM s a JOIN s b ON a.dt = b.dt WHERE a.id % 50 = 0) "
       "SELECT qid AS query_id, iid AS item_id, round(sum(w * d) / count(*), 9) AS dist FROM w GROUP BY ALL")
def fuse_mean_uncut(spark, sf):
    """Whole lists: items with an id divisible by 50 ask for all items."""
    return best_fused(spark, sf, "mean")


@query("fuse_radicals",
       f"WITH {WHOLE}, v AS (SELECT qid, iid, max(CASE dt WHEN 's1' THEN d END) AS d1, max(CASE dt WHEN 's2' THEN d END) AS d2, "
       "max(CASE dt WHEN 's3' THEN d END) AS d3, max(CASE dt WHEN 's4' THEN d END) AS d4 FROM w GROUP BY ALL) "
       f"SELECT qid AS query_id, iid AS item_id, round(d4 * sqrt(d3 * sqrt(d2 * sqrt(d1))), 6) AS dist FROM v")
def fuse_radicals(spark, sf):
    return best_fused(spark, sf, "radicals")


# Multi-vector queries: the conversation of a turn is the object, its turns are the rows. A row's
# vector holds the text length and the counts of four letters.
_TURN = "[CAST(length(text) AS DOUBLE)" + "".join(
    f", CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in "aeit"
) + "]"
_ROWS = f"t AS (SELECT conv_id, turn, conv_id * 100 + turn AS rid, {_TURN} AS v FROM conversations)"


def turn_rows(spark, sf):
    t = F.col("text")
    letters = [F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "aeit"]
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array(F.length(t), *letters).cast("array<double>").alias("vec")
    )


_VOTE = (
    _ROWS + ", n AS (SELECT a.conv_id AS qid, a.turn AS turn, b.rid AS rid, b.conv_id AS iid, round(list_distance(a.v, b.v), 6) AS d, "
    "row_number() OVER (PARTITION BY a.rid ORDER BY round(list_distance(a.v, b.v), 6), b.rid) AS r FROM t a, t b QUALIFY r <= 5), "
    "o AS (SELECT qid, turn, iid, min(d) AS d FROM n GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY qid, turn ORDER BY d, iid) - 1 AS r FROM o)"
)


@query("vote_rows",
       f"WITH {_VOTE}, l AS (SELECT qid, max(n) AS len FROM (SELECT qid, turn, count(*) AS n FROM k GROUP BY ALL) GROUP BY qid), "
       "p AS (SELECT qid, iid, CAST(sum(len - r) AS DOUBLE) AS pts, min(d) AS d FROM k JOIN l USING (qid) GROUP BY ALL), "
       "m AS (SELECT qid, greatest(1.0, max(pts)) + 1 AS m FROM p GROUP BY qid), "
       "b AS (SELECT qid, iid, round(CASE WHEN d = 0 THEN 0 ELSE (m - pts) / m END, 6) AS borda FROM p JOIN m USING (qid)), "
       "a AS (SELECT qid, iid, round(avg(d), 9) AS mean FROM k GROUP BY ALL) "
       "SELECT qid AS query_id, iid AS item_id, borda, mean FROM b JOIN a USING (qid, iid)")
def vote_rows(spark, sf):
    rows = turn_rows(spark, sf)
    rid = (F.col("conv_id") * 100 + F.col("turn")).alias("query_id")
    x = rows.select(rid.alias("item_id"), "vec")
    hits = similarity.search(rows.select(rid, "vec"), x, top_n=5)
    voted = hits.select(
        F.floor(F.col("query_id") / 100).alias("query_id"),
        (F.col("query_id") % 100).alias("by"),
        F.floor(F.col("item_id") / 100).alias("item_id"),
        "dist",
    ).groupBy("query_id", "by", "item_id").agg(F.min("dist").alias("dist"))
    borda = fusion.vote_rows(voted, by_rank=True).withColumnRenamed("dist", "borda")
    mean = fusion.vote_rows(voted, by_rank=False).withColumnRenamed("dist", "mean")
    return borda.join(mean, ["query_id", "item_id"])


@query("max_k", "SELECT CAST(min(n) AS BIGINT) AS max_k FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def max_k(spark, sf):
    return aggregates.max_k(table(spark, sf, "conversations"), "conv_id")


@query("index_radius",
       f"WITH {CENTROIDS}, g AS (SELECT list(m ORDER BY pos) AS v FROM (SELECT g.pos AS pos, avg(v[g.pos]) AS m "
       "FROM e, (SELECT unnest(range(1, 65)) AS pos) g GROUP BY ALL)) "
       "SELECT round(max(list_distance(e.v, g.v)), 6) AS radius FROM e, g")
def index_radius(spark, sf):
    x = items(spark, sf)
    centre = F.array(*map(F.lit, similarity.centroid(x).first()[0]))
    return x.agg(rounded(F.max(vectors.dist_l2(F.col("vec"), centre))).alias("radius"))


@query("hist_uint",
       "WITH v AS (SELECT CAST(l_quantity AS BIGINT) AS bin FROM lineitem) "
       "SELECT bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM v), 6) AS share, "
       "(SELECT round(avg(bin), 6) FROM v) AS mean, (SELECT round(stddev_pop(bin), 6) FROM v) AS std, "
       "(SELECT CAST(sum(bin) AS BIGINT) FROM v) AS total FROM v GROUP BY bin")
def hist_uint(spark, sf):
    return aggregates.histogram(
        table(spark, sf, "lineitem").select(F.col("l_quantity").cast("bigint").alias("bin"))
    )


@query("hist_region_stats",
       "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) "
       "SELECT 'children' AS what, CAST(n AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS cnt FROM c GROUP BY n UNION ALL "
       "SELECT 'diameter', CAST(greatest(CAST(l_quantity AS BIGINT) + 8, CAST(l_quantity AS BIGINT) % 17 + 8) AS BIGINT) AS bin, "
       "CAST(count(*) AS BIGINT) FROM lineitem GROUP BY ALL")
def hist_region_stats(spark, sf):
    t = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    children = t.groupBy("l_orderkey").count().groupBy(F.col("count").alias("bin")).agg(F.count("*").alias("cnt"))
    sizes = t.groupBy(F.greatest(q + 8, q % 17 + 8).alias("bin")).agg(F.count("*").alias("cnt"))
    return children.select(F.lit("children").alias("what"), "bin", "cnt").unionByName(
        sizes.select(F.lit("diameter").alias("what"), "bin", "cnt")
    )


@query("hist_cells",
       "WITH c AS (SELECT user_id, hour(ts) // 6 AS cell, CAST(least(3, floor(value / 30)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL), "
       "t AS (SELECT user_id, cell, sum(n) AS t FROM c GROUP BY ALL), "
       "g AS (SELECT u.user_id, a.cell, b.bin FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(0, 4)) AS cell) a, (SELECT unnest(range(0, 4)) AS bin) b) "
       "SELECT g.user_id, CAST(g.cell * 4 + g.bin AS BIGINT) AS pos, round(coalesce(c.n, 0) / greatest(coalesce(t.t, 0), 1), 6) AS v "
       "FROM g LEFT JOIN c USING (user_id, cell, bin) LEFT JOIN t USING (user_id, cell)")
def hist_cells(spark, sf):
    e = table(spark, sf, "events")
    vec = aggregates.cell_histogram(
        e, "user_id", F.floor(F.hour("ts") / 6).cast("int"), F.least(F.lit(3), F.floor(F.col("value") / 30)).cast("int"), 4, 4
    )
    return vec.select("user_id", F.posexplode("vec")).select(
        "user_id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("col")).alias("v")
    )


@query("time_hist",
       "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(avg(value), 9) AS mean FROM events GROUP BY ALL")
def time_hist(spark, sf):
    return aggregates.time_hist(table(spark, sf, "events"), "event_type", "value")


@query("timing_rollup",
       "SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span, round(avg(value), 9) AS transport FROM events GROUP BY ALL")
def timing_rollup(spark, sf):
    return aggregates.timing_rollup(table(spark, sf, "events"), "user_id", "ts", "value")


@query("distinct_errors",
       "WITH e AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'error' AND value > 60 THEN 'over ' || CAST(floor(value / 30) AS BIGINT) * 30 END AS e FROM events) "
       "SELECT user_id, coalesce(string_agg(e, '; ' ORDER BY e), 'SUCCESS') AS result FROM e GROUP BY ALL")
def distinct_errors(spark, sf):
    text = F.concat(F.lit("over "), (F.floor(F.col("value") / 30) * 30).cast("string"))
    error = F.when((F.col("event_type") == "error") & (F.col("value") > 60), text)
    return aggregates.distinct_errors(table(spark, sf, "events"), "user_id", error)
