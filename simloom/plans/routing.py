"""Facet routing of customers, overflow buckets, fan-out and the result cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.scalars import rounded
from simloom.operators import ranking, routing, similarity
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import CENTROIDS, E, as_queries, centroids, items

# Facet A: the market segment, AUTOMOBILE counting as unknown. Facet B: bands of the balance / 200.
SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_C = (
    "c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Unknown' ELSE c_mktsegment END AS a, c_acctbal / 200 AS b FROM customer)"
)
_BAND = "CASE WHEN b < 0 THEN ['Unknown'] WHEN b < 16 THEN ['low'] WHEN b <= 20 THEN ['low', 'high'] ELSE ['high'] END"
_ROUTED = f"{_C}, i AS (SELECT c_custkey, a AS facet_a, unnest({_BAND}) AS facet_b FROM c)"
_ASKED = (
    f"{_C}, q0 AS (SELECT *, {_BAND} AS bs FROM c), "
    "q1 AS (SELECT *, unnest(CASE WHEN a = 'Unknown' THEN ['BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'Unknown'] ELSE [a, 'Unknown'] END) AS facet_a FROM q0), "
    "q AS (SELECT c_custkey, a, bs, facet_a, unnest(CASE WHEN bs[1] = 'Unknown' THEN ['low', 'high', 'Unknown'] ELSE list_append(bs, 'Unknown') END) AS facet_b FROM q1)"
)


def customers(spark, sf):
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(seg != "AUTOMOBILE", seg).alias("a"), (F.col("c_acctbal") / 200).alias("b")
    )


def routed(spark, sf):
    return routing.route_items(customers(spark, sf), F.col("a"), F.col("b"))


def asked(spark, sf):
    return routing.route_queries(customers(spark, sf), F.col("a"), F.col("b"), SEGMENTS)


@query("facet_route_ingest", f"WITH {_ROUTED} SELECT c_custkey, facet_a, facet_b FROM i")
def facet_route_ingest(spark, sf):
    return routed(spark, sf).select("c_custkey", "facet_a", "facet_b")


@query("facet_route_query", f"WITH {_ASKED} SELECT c_custkey, facet_a, facet_b FROM q")
def facet_route_query(spark, sf):
    return asked(spark, sf).select("c_custkey", "facet_a", "facet_b")


@query("join_facets",
       f"WITH {_ASKED}, i AS (SELECT DISTINCT a AS fa, unnest({_BAND}) AS fb FROM c WHERE a <> 'MACHINERY') "
       "SELECT c_custkey, facet_a, facet_b FROM q JOIN i ON fa = facet_a AND fb = facet_b")
def join_facets(spark, sf):
    present = routed(spark, sf).filter("facet_a <> 'MACHINERY'")
    return routing.buckets_of(asked(spark, sf), present).select("c_custkey", "facet_a", "facet_b")


_EMB = (
    f"{_ROUTED}, m AS (SELECT facet_a, facet_b, vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings JOIN i ON c_custkey = vec_id), "
)


# Items are the embeddings under the facets of the customer with their number; queries likewise.
@query("facet_penalty",
       f"WITH {_ASKED}, i AS (SELECT c_custkey, a AS facet_a, unnest({_BAND}) AS facet_b FROM c), "
       "m AS (SELECT facet_a, facet_b, vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings JOIN i ON c_custkey = vec_id), "
       "qq AS (SELECT DISTINCT c_custkey AS qid, facet_a, facet_b, bs[1] <> 'Unknown' AND facet_b = 'Unknown' AND (facet_a = 'Unknown' OR a = 'Unknown') AS pen, "
       "list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM q JOIN embeddings ON c_custkey = vec_id), "
       "h AS (SELECT qid, m.vec_id AS iid, pen, round(2 / pi() * atan(pi() / 2 * list_distance(qq.v, m.v)), 6) AS d FROM qq JOIN m USING (facet_a, facet_b) WHERE m.vec_id <> qid), "
       "p AS (SELECT qid, iid, min(round(CASE WHEN pen THEN sqrt(d) ELSE d END, 6)) AS d FROM h GROUP BY ALL) "
       "SELECT qid AS query_id, iid AS item_id, d AS dist, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM p QUALIFY rank <= 5")
def facet_penalty(spark, sf):
    x = items(spark, sf)
    bucket = F.concat_ws(".", "facet_a", "facet_b")
    cust = customers(spark, sf).withColumnRenamed("c_custkey", "item_id")
    placed = routing.route_items(x.join(cust, "item_id"), F.col("a"), F.col("b")).select("item_id", "vec", bucket.alias("by"))
    routes = routing.route_queries(x.join(cust, "item_id"), F.col("a"), F.col("b"), SEGMENTS)
    routes = routes.select(F.col("item_id").alias("query_id"), "vec", bucket.alias("by"), "penalty")
    # Five per query and bucket are enough for the best five overall.
    hits = similarity.search(routes.drop("penalty"), placed, top_n=5, skip="id", scale=1.0)
    flagged = hits.drop("rank").join(routes.select("query_id", "by", "penalty"), ["query_id", "by"])
    return ranking.merge_top_k(routing.apply_penalty(flagged), 5)


@query("overflow_split",
       "SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 100 + 1 AS BIGINT) AS overflow_no FROM customer")
def overflow_split(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return routing.overflow(t, ["c_mktsegment"], ["c_custkey"], limit=100)


@query("overflow_names",
       "WITH b AS (SELECT c_mktsegment AS bucket, CAST((count(*) - 1) // 100 + 1 AS BIGINT) AS n FROM customer GROUP BY ALL) "
       "SELECT bucket, bucket || '.' || i AS name, i AS level FROM (SELECT bucket, unnest(range(1, n + 1)) AS i FROM b)")
def overflow_names(spark, sf):
    sizes = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("bucket")).agg(
        (F.floor((F.count("*") - 1) / 100) + 1).alias("n")
    )
    return routing.overflow_names(sizes).withColumn("level", routing.overflow_level(F.col("name")))


@query("annotation_facets",
       "SELECT c_custkey, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_mktsegment WHEN c_nationkey % 3 = 0 THEN 'BUILDING' ELSE 'Unknown' END AS facet FROM customer")
def annotation_facets(spark, sf):
    seg = F.col("c_mktsegment")
    facet = F.when(seg == "AUTOMOBILE", F.lit("Unknown")).otherwise(seg)
    note = F.when(F.col("c_nationkey") % 3 == 0, "BUILDING")
    return table(spark, sf, "customer").select("c_custkey", routing.annotated_facet(facet, note).alias("facet"))


_HITS = (
    f"{CENTROIDS}, h AS (SELECT c.id AS qid, e.id AS iid, e.id % 6 AS ev, round(list_distance(c.v, e.v), 6) AS d FROM c, e)"
)


def fanned(spark, sf, k):
    """Rankings of each query from each of six partitions of the items."""
    x = items(spark, sf).withColumn("by", F.col("item_id") % 6)
    q = centroids(spark, sf).withColumn("by", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(6)])))
    return similarity.search(q, x, top_n=k)


@query("fanout_query",
       f"WITH {_HITS} SELECT qid AS query_id, iid AS item_id, d AS dist, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM h WHERE ev IN (0, 2, 5) AND d <= 1.05 QUALIFY rank <= 8")
def fanout_query(spark, sf):
    x = items(spark, sf).withColumn("by", F.col("item_id") % 6)
    chosen = F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 2, 5)]))
    hits = similarity.search(centroids(spark, sf).withColumn("by", chosen), x, top_n=8, max_dist=1.05)
    return ranking.merge_top_k(hits, 8)


@query("fanout_collections",
       f"WITH {_HITS} SELECT ev AS event_id, qid AS query_id, iid AS item_id, d AS dist, row_number() OVER (PARTITION BY ev, qid ORDER BY d, iid) AS rank FROM h QUALIFY rank <= 4")
def fanout_collections(spark, sf):
    return fanned(spark, sf, 4).select(F.col("by").cast("bigint").alias("event_id"), "query_id", "item_id", "dist", "rank")


# Cache: one entry per (status, customer group, priority, order); a bucket is a priority.
_KEYS = "o_orderstatus AS app, o_custkey % 20 AS event_id, o_orderpriority AS bucket, CAST(o_orderkey AS VARCHAR) AS request"
_CACHE = f"ca AS (SELECT {_KEYS}, CAST(o_totalprice AS VARCHAR) AS hits FROM orders WHERE o_orderkey % 3 <> 0)"


def cache(spark, sf):
    t = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("app"), (F.col("o_custkey") % 20).alias("event_id"), F.col("o_orderpriority").alias("bucket"),
        F.col("o_orderkey").cast("string").alias("request"), "o_orderkey",
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("hits"),
    )
    return t


_CACHE = _CACHE.replace("CAST(o_totalprice AS VARCHAR)", "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)")


@query("cache_lookup", f"WITH {_CACHE}, w AS (SELECT {_KEYS} FROM orders) SELECT w.*, hits FROM w LEFT JOIN ca USING (app, event_id, bucket, request)")
def cache_lookup(spark, sf):
    t = cache(spark, sf)
    return routing.cache_lookup(t.select(*routing.CACHE_KEY), t.filter("o_orderkey % 3 <> 0").drop("o_orderkey"))


@query("cache_store",
       f"WITH {_CACHE}, fr AS (SELECT {_KEYS}, 'new' AS hits FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM ca WHERE request NOT IN (SELECT request FROM fr) UNION ALL FROM fr")
def cache_store(spark, sf):
    t = cache(spark, sf)
    fresh = t.filter("o_orderkey % 2 = 0").withColumn("hits", F.lit("new"))
    return routing.cache_store(t.filter("o_orderkey % 3 <> 0").drop("o_orderkey"), fresh.drop("o_orderkey"))


@query("cache_invalidate",
       f"WITH {_CACHE}, tc AS (SELECT DISTINCT {_KEYS} FROM orders WHERE o_custkey % 20 < 4 AND o_orderkey % 3 = 0) SELECT * FROM ca WHERE NOT EXISTS "
       "(SELECT 1 FROM tc WHERE tc.app = ca.app AND tc.event_id = ca.event_id AND tc.bucket = ca.bucket)")
def cache_invalidate(spark, sf):
    t = cache(spark, sf)
    touched = t.filter("event_id < 4 AND o_orderkey % 3 = 0")
    return routing.cache_invalidate(t.filter("o_orderkey % 3 <> 0").drop("o_orderkey"), touched)
