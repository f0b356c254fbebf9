"""Similarity, region and request joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import rects, scalars, vectors
from simloom.operators import matches, regions, requests, similarity, signature_join, ann
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import (
    BOXES,
    CENTROIDS,
    E,
    SLICED,
    as_queries,
    boxes,
    centroid_hits,
    centroids,
    iou,
    items,
    neighbours,
    overlap,
    slices,
    unit,
    unit01,
)

HITS = ("query_id", "item_id", "dist", "rank")


def _ranked(sql_from: str, where: str = "true", cut: str = "") -> str:
    return (
        f"SELECT qid AS query_id, iid AS item_id, d AS dist, "
        f"row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS rank FROM {sql_from} "
        f"WHERE {where} {cut}"
    )


@query("join_radius", f"WITH {centroid_hits()} " + _ranked("h", "d <= 0.99"))
def join_radius(spark, sf):
    return similarity.search(centroids(spark, sf), items(spark, sf), max_dist=0.99, rank=True).select(*HITS)


@query("join_knn", f"WITH {neighbours(5)} SELECT qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM n")
def join_knn(spark, sf):
    x = items(spark, sf)
    return similarity.search(as_queries(x), x, top_n=5, skip="id").select(*HITS)


#: A layout for queries that take their rows through the grid, however small the table.
GRID = {"scan_rows": 0, "block_rows": 64}


@query("join_radius_grid", f"WITH {centroid_hits()} " + _ranked("h", "d <= 0.99"))
def join_radius_grid(spark, sf):
    return similarity.search(centroids(spark, sf), items(spark, sf), max_dist=0.99, rank=True, **GRID).select(*HITS)


@query("join_knn_grid", f"WITH {neighbours(5)} SELECT qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM n")
def join_knn_grid(spark, sf):
    x = items(spark, sf)
    return similarity.search(as_queries(x), x, top_n=5, skip="id", scan_rows=0).select(*HITS)


@query("join_knn_within",
       f"WITH {neighbours(5)} SELECT qid AS query_id, iid AS item_id, d AS dist, r AS rank FROM n "
       "WHERE d <= 1.1")
def join_knn_within(spark, sf):
    x = items(spark, sf)
    return similarity.search(as_queries(x), x, top_n=5, max_dist=1.1, skip="id").select(*HITS)


@query("join_exact",
       "WITH q AS (SELECT text, min(doc_id) AS qid FROM documents GROUP BY text) "
       "SELECT q.qid AS query_id, d.doc_id AS item_id, CAST(0 AS DOUBLE) AS dist "
       "FROM q JOIN documents d ON q.text = d.text")
def join_exact(spark, sf):
    docs = table(spark, sf, "documents")
    firsts = docs.groupBy("text").agg(F.min("doc_id").alias("query_id"))
    return similarity.search_exact(
        firsts.withColumnRenamed("text", "vec"),
        docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("vec")),
    )


@query("join_all", f"WITH {centroid_hits()} " + _ranked("h"))
def join_all(spark, sf):
    return similarity.search(centroids(spark, sf), items(spark, sf), rank=True).select(*HITS)


@query("join_skip_self",
       f"WITH {neighbours(4, True)} SELECT 'id' AS mode, qid AS query_id, iid AS item_id, d AS dist "
       "FROM n WHERE qid <> iid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, iid) <= 3 "
       "UNION ALL SELECT 'zero', qid, iid, d FROM (SELECT a.id AS qid, b.id AS iid, "
       "round(list_distance(a.v, b.v), 6) AS d FROM e a, e b) WHERE d > 0 "
       "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, iid) <= 3")
def join_skip_self(spark, sf):
    x = items(spark, sf)
    found = [
        similarity.search(as_queries(x), x, top_n=3, skip=mode).select(
            F.lit(mode).alias("mode"), "query_id", "item_id", "dist"
        )
        for mode in ("id", "zero")
    ]
    return found[0].unionByName(found[1])


@query("join_kind_penalty",
       f"WITH {CENTROIDS}, p AS (SELECT c.id AS qid, e.id AS iid, "
       f"round({unit('list_distance(c.v, e.v)')}, 6) AS u, c.id % 3 <> e.label % 3 AS other FROM c, e), "
       "f AS (SELECT qid, iid, round(CASE WHEN other THEN sqrt(u) ELSE u END, 6) AS d FROM p) "
       "SELECT qid AS query_id, iid AS item_id, d AS dist FROM f WHERE d <= 0.75")
def join_kind_penalty(spark, sf):
    x = items(spark, sf).withColumn("kind", F.col("label") % 3)
    q = centroids(spark, sf).withColumn("kind", F.col("query_id") % 3)
    return similarity.search_penalised(q, x, max_dist=0.75, scale=1.0).select(
        "query_id", "item_id", "dist"
    )


@query("join_ann_lsh")
def join_ann_lsh(spark, sf):
    x = items(spark, sf)
    return ann.lsh_neighbours(as_queries(x), x, top_n=5)


@query("join_ann_ivf")
def join_ann_ivf(spark, sf):
    x = items(spark, sf)
    return ann.cell_neighbours(as_queries(x), x, top_n=5)


@query("join_pivot_radius",
       f"WITH {CENTROIDS}, g AS (SELECT list(m ORDER BY pos) AS v FROM (SELECT g.pos AS pos, "
       "round(avg(v[g.pos]), 9) AS m FROM e, (SELECT unnest(range(1, 65)) AS pos) g GROUP BY ALL)) "
       "SELECT c.id AS query_id, e.id AS item_id, round(list_distance(c.v, e.v), 6) AS dist "
       "FROM c, e WHERE round(list_distance(c.v, e.v), 6) <= 0.99")
def join_pivot_radius(spark, sf):
    return similarity.pivot_radius(centroids(spark, sf), items(spark, sf), 0.99)


_SIG = (
    E + ", sg AS (SELECT id, v[1] AS a0, list(k ORDER BY r) AS sig FROM (SELECT e.id, e.v, "
    "CAST(sign(e.v[g.p + 2]) * g.p AS BIGINT) AS k, row_number() OVER (PARTITION BY e.id "
    "ORDER BY abs(e.v[g.p + 2]) DESC, g.p) AS r FROM e, (SELECT unnest(range(0, 63)) AS p) g "
    "QUALIFY r <= 16) GROUP BY id, v[1])"
)
_BIN = "least(5, greatest(abs(t[1]) // 8, abs(t[1]) % 8))"
_W0 = f"[0.78, 0.46, 0.42, 0.41, 0.32][CAST({_BIN} AS BIGINT)]"
_WT = f"CASE WHEN t[1] <> 0 AND t[1] = t[2] THEN (CASE WHEN {_BIN} = 0 THEN 4.04 ELSE CAST({_W0} AS DOUBLE) END) ELSE 0.0 END"


def sig_diff(a: str, b: str) -> str:
    return (
        f"(abs({a}.a0 - {b}.a0) * 4.04 - list_sum(list_transform(list_zip({a}.sig, {b}.sig), "
        f"lambda t: CAST({_WT} AS DOUBLE))))"
    )


@query("join_signature",
       f"WITH {_SIG}, m AS (SELECT a.id AS qid, b.id AS iid, list_sum(list_transform("
       "list_zip(a.sig, b.sig), lambda t: CASE WHEN t[1] <> 0 AND t[1] = t[2] THEN 1 ELSE 0 END)) AS hit, "
       f"{sig_diff('a', 'b')} AS diff FROM sg a, sg b WHERE a.id <> b.id) "
       f"SELECT qid AS query_id, iid AS item_id, round({unit01('0.75 * diff')}, 6) AS dist FROM m "
       "WHERE hit > 0 AND "
       f"round({unit01('0.75 * diff')}, 6) < 0.45")
def join_signature(spark, sf):
    x = items(spark, sf).select("item_id", F.array(vectors.signature(F.col("vec"), 16)).alias("channels"))
    return signature_join.join_signature(
        as_queries(x), x, dim=8, scale=0.75, below=0.45
    )


@query("join_set_nearest",
       f"WITH {E}, q AS (SELECT id, id // 4 AS g, v FROM e), "
       "d AS (SELECT a.g AS ga, b.g AS gb, a.id AS ia, b.id AS ib, list_distance(a.v, b.v) AS d "
       "FROM q a, q b WHERE b.g > a.g AND b.g <= a.g + 8), "
       "l AS (SELECT ga, gb, avg(m) AS m FROM (SELECT ga, gb, ia, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), "
       "r AS (SELECT ga, gb, avg(m) AS m FROM (SELECT ga, gb, ib, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL) "
       f"SELECT l.ga AS set_a, l.gb AS set_b, round({unit('(l.m + r.m) / 2')}, 6) AS dist FROM l JOIN r USING (ga, gb)")
def join_set_nearest(spark, sf):
    rows = items(spark, sf).select(
        F.floor(F.col("item_id") / 4).alias("set_id"), F.col("item_id").alias("row"), "vec"
    )
    sets = rows.select("set_id").distinct()
    pairs = sets.select(
        F.col("set_id").alias("set_a"), F.explode(F.sequence(F.col("set_id") + 1, F.col("set_id") + 8)).alias("set_b")
    )
    return matches.set_distance(pairs, rows, scale=1.0)


@query("join_set_nearest_all",
       f"WITH {E}, q AS (SELECT id, id // 4 AS g, v FROM e), "
       "d AS (SELECT a.g AS ga, b.g AS gb, a.id AS ia, b.id AS ib, list_distance(a.v, b.v) AS d "
       "FROM q a, q b WHERE b.g <> a.g AND a.g % 50 = 0), "
       "l AS (SELECT ga, gb, avg(m) AS m FROM (SELECT ga, gb, ia, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), "
       "r AS (SELECT ga, gb, avg(m) AS m FROM (SELECT ga, gb, ib, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL) "
       f"SELECT l.ga AS set_a, l.gb AS set_b, round({unit('(l.m + r.m) / 2')}, 6) AS dist FROM l JOIN r USING (ga, gb)")
def join_set_nearest_all(spark, sf):
    """Only the asking side is bounded: sets with an id divisible by 50 meet all sets of the table."""
    rows = items(spark, sf).select(
        F.floor(F.col("item_id") / 4).alias("set_id"), F.col("item_id").alias("row"), "vec"
    )
    sets = rows.select("set_id").distinct()
    asking = sets.filter("set_id % 50 = 0").withColumnRenamed("set_id", "set_a")
    pairs = asking.join(sets.withColumnRenamed("set_id", "set_b"), F.col("set_a") != F.col("set_b"))
    return matches.set_distance(pairs, rows, scale=1.0)


@query("join_crosscheck",
       f"WITH {neighbours(5)} SELECT a.qid AS query_id, a.iid AS item_id, a.d AS dist FROM n a "
       "JOIN n b ON a.qid = b.iid AND a.iid = b.qid")
def join_crosscheck(spark, sf):
    x = items(spark, sf)
    return matches.crosscheck(similarity.search(as_queries(x), x, top_n=5, skip="id")).select(
        "query_id", "item_id", "dist"
    )


@query("join_ordered_pairs",
       "SELECT a.conv_id AS left_id, b.conv_id AS right_id, a.turn AS row, "
       "CAST(length(a.text) AS BIGINT) AS left_len, CAST(length(b.text) AS BIGINT) AS right_len "
       "FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 AND a.turn = b.turn "
       "JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL) ca ON ca.conv_id = a.conv_id "
       "JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL) cb ON cb.conv_id = b.conv_id "
       "WHERE ca.n = cb.n")
def join_ordered_pairs(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("set_id"), F.col("turn").alias("row"), F.length("text").cast("bigint").alias("len")
    )
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    pairs = (
        sizes.select(F.col("set_id").alias("left_id"), "n")
        .join(sizes.select((F.col("set_id") - 1).alias("left_id"), F.col("set_id").alias("right_id"),
                           F.col("n").alias("m")), "left_id")
        .filter("n = m")
        .select("left_id", "right_id")
    )
    return matches.ordered_pairs(pairs, rows, "len")


@query("join_weight_mask",
       "SELECT a.l_orderkey AS img, CAST(count(*) AS BIGINT) AS pairs FROM lineitem a JOIN lineitem b "
       "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber "
       "WHERE sqrt(a.l_discount * b.l_tax) > 0.00001 GROUP BY ALL")
def join_weight_mask(spark, sf):
    t = table(spark, sf, "lineitem")
    a = t.select(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("row"), F.col("l_discount").alias("w1"))
    b = t.select(F.col("l_orderkey").alias("img"), (F.col("l_linenumber") - 1).alias("row"), F.col("l_tax").alias("w2"))
    met = a.join(b, ["img", "row"]).filter(matches.weight_mask(F.col("w1"), F.col("w2")))
    return met.groupBy("img").agg(F.count("*").alias("pairs"))


@query("filter_match_mindist",
       f"WITH {neighbours(10)}, g AS (SELECT *, qid // 10 AS pair, min(d) OVER (PARTITION BY qid // 10) AS m FROM n) "
       "SELECT pair, qid AS query_id, iid AS item_id, d AS dist FROM g WHERE d <= greatest(2 * m, 0.5)")
def filter_match_mindist(spark, sf):
    x = items(spark, sf)
    found = similarity.search(as_queries(x), x, top_n=10, skip="id").withColumn(
        "pair", F.floor(F.col("query_id") / 10)
    )
    return matches.keep_near_min(found, radius=0.5).select("pair", "query_id", "item_id", "dist")


_MAD = (
    "p AS (SELECT l_suppkey AS pair, l_orderkey * 10 + l_linenumber AS row, l_partkey, "
    "sqrt((l_quantity / 50 - l_discount * 10) * (l_quantity / 50 - l_discount * 10) + "
    "(l_tax * 10 - l_extendedprice / 100000) * (l_tax * 10 - l_extendedprice / 100000)) AS g FROM lineitem), "
    "m AS (SELECT pair, quantile_cont(g, 0.5) AS med, count(*) AS n FROM p GROUP BY pair), "
    "s AS (SELECT p.*, m.n, row_number() OVER (PARTITION BY p.pair ORDER BY round(abs(g - med), 9), row, l_partkey) AS r "
    "FROM p JOIN m USING (pair)) "
)


@query("filter_match_mad",
       f"WITH {_MAD} SELECT pair, row, l_partkey AS part, round(g, 9) AS gap FROM s WHERE r <= (n + 1) // 2")
def filter_match_mad(spark, sf):
    q, d = F.col("l_quantity") / 50, F.col("l_discount") * 10
    t, p = F.col("l_tax") * 10, F.col("l_extendedprice") / 100000
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pair"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
        F.col("l_partkey").alias("part"),
        F.sqrt((q - d) * (q - d) + (t - p) * (t - p)).alias("gap"),
    )
    return matches.keep_central_half(rows, "pair", "gap", ["row", "part"]).select(
        "pair", "row", "part", scalars.rounded(F.col("gap"), 9).alias("gap")
    )


@query("filter_match_region",
       f"WITH {neighbours(5)}, k AS (SELECT *, CASE ql % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'n' ELSE 'f' END AS qk, "
       "CASE il % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'n' ELSE 'f' END AS ik FROM n) "
       "SELECT qid AS query_id, iid AS item_id, round(CASE WHEN qk = ik THEN d ELSE 2 * d END, 6) AS dist "
       "FROM k WHERE qk = ik OR qk = 'f' OR ik = 'f'")
def filter_match_region(spark, sf):
    x = items(spark, sf)
    kind = F.when(F.col("label") % 3 == 0, "i").when(F.col("label") % 3 == 1, "n").otherwise("f")
    kinds = x.select("item_id", kind.alias("kind"))
    found = similarity.search(as_queries(x), x, top_n=5, skip="id")
    return matches.same_region(found, kinds).select("query_id", "item_id", "dist")


@query("agg_match_distance",
       f"WITH {neighbours(5)}, g AS (SELECT ql AS a, il AS b, d FROM n) "
       "SELECT a, b, CASE WHEN count(*) < 4 AND quantile_cont(d, 0.5) <> 0 THEN 1.0 ELSE round(quantile_cont(d, 0.5), 9) END AS median_dist, "
       "CASE WHEN count(*) < 4 AND avg(d) <> 0 THEN 1.0 ELSE round(avg(d), 9) END AS mean_dist, "
       "CASE WHEN count(*) < 4 AND max(d) <> 0 THEN 1.0 ELSE round(max(d), 9) END AS max_dist FROM g GROUP BY ALL")
def agg_match_distance(spark, sf):
    x = items(spark, sf)
    labels = x.select("item_id", "label")
    found = (
        similarity.search(as_queries(x), x, top_n=5, skip="id")
        .join(labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("a")), "query_id")
        .join(labels.withColumnRenamed("label", "b"), "item_id")
    )
    return matches.match_distance(found, ["a", "b"])


@query("dist_pair",
       f"WITH {E}, p AS (SELECT vec_id AS a, vec_id + 7 AS b FROM embeddings) "
       f"SELECT p.a AS a_id, p.b AS b_id, round(coalesce({unit('list_distance(x.v, y.v)')}, 1), 6) AS dist "
       "FROM p LEFT JOIN e x ON x.id = p.a LEFT JOIN e y ON y.id = p.b")
def dist_pair(spark, sf):
    x = items(spark, sf)
    pairs = x.select(F.col("item_id").alias("a_id"), (F.col("item_id") + 7).alias("b_id"))
    return similarity.pair_distance(pairs, x)


def _abs_sum(expr: str) -> str:
    return f"list_sum(list_transform(list_zip(c.v, e.v), lambda t: {expr}))"


@query("distance_matrix",
       f"WITH {CENTROIDS} SELECT 'l1' AS metric, c.id AS query_id, e.id AS item_id, "
       f"round({_abs_sum('abs(t[1] - t[2])')}, 6) AS dist FROM c, e UNION ALL "
       "SELECT 'l2', c.id, e.id, round(list_distance(c.v, e.v), 6) FROM c, e UNION ALL "
       f"SELECT 'hamming', c.id, e.id, CAST({_abs_sum('CASE WHEN (t[1] > 0) <> (t[2] > 0) THEN 1 ELSE 0 END')} AS DOUBLE) FROM c, e")
def distance_matrix(spark, sf):
    q, x = centroids(spark, sf), items(spark, sf)
    parts = [
        similarity.search(q, x, metric=m).select(F.lit(m).alias("metric"), "query_id", "item_id", "dist")
        for m in ("l1", "l2", "hamming")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("match_lists",
       f"WITH {CENTROIDS} SELECT c.id AS query_id, e.id AS item_id, round({unit('0.5 * list_distance(c.v, e.v)')}, 6) AS dist "
       f"FROM c, e WHERE round({unit('0.5 * list_distance(c.v, e.v)')}, 6) <= 0.5")
def match_lists(spark, sf):
    return similarity.search(
        centroids(spark, sf), items(spark, sf), max_dist=scalars.DEFAULT_RADIUS, scale=0.5
    ).select("query_id", "item_id", "dist")


@query("join_request_region",
       "SELECT conv_id * 100 + turn AS request_id, CAST(u.i AS BIGINT) AS region_no, "
       "'f[' || u.i || ',' || turn || ';' || (length(text) % 50 + 8) || ',20]' AS region "
       "FROM conversations, (SELECT unnest(range(1, 4)) AS i) u WHERE u.i <= turn % 3 + 1")
def join_request_region(spark, sf):
    t = table(spark, sf, "conversations")
    tail = F.concat(F.lit(","), F.col("turn"), F.lit(";"), F.length("text") % 50 + 8, F.lit(",20]"))
    parts = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("turn") % 3 + 1), lambda i: F.concat(F.lit("f["), i, tail)
    )
    lines = t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
        F.concat(F.lit("file\t"), F.array_join(parts, "\t")).alias("line"),
    )
    return requests.explode_regions(lines)


@query("join_multi_probe",
       f"WITH {CENTROIDS}, p AS (SELECT id, v FROM c UNION ALL SELECT id, list_reverse(v) FROM c "
       "UNION ALL SELECT id, list_transform(v, lambda t: -t) FROM c) "
       "SELECT p.id AS query_id, e.id AS item_id, min(round(list_distance(p.v, e.v), 6)) AS dist "
       "FROM p, e WHERE round(list_distance(p.v, e.v), 6) <= 1.0 GROUP BY ALL")
def join_multi_probe(spark, sf):
    q = centroids(spark, sf).withColumn(
        "probes", F.array("vec", F.reverse("vec"), F.transform("vec", lambda t: -t))
    )
    return requests.multi_probe(q, items(spark, sf), max_dist=1.0)


_FOUND = (
    BOXES + ", g AS (SELECT * FROM b WHERE status = 'O'), "
    "f AS (SELECT img, rid, kind, x + rid % 5 AS x, y + rid % 3 AS y, w, h FROM b)"
)


def given_found(spark, sf):
    b = boxes(spark, sf)
    given = b.filter("status = 'O'")
    found = b.withColumn("r", rects.shift(F.col("r"), (F.col("rid") % 5).cast("int"), (F.col("rid") % 3).cast("int")))
    return given, found


@query("join_iou",
       f"WITH {_FOUND} SELECT g.img AS img, g.rid AS given, f.rid AS found, {overlap('g', 'f')} AS area, "
       f"round({iou('g', 'f')}, 6) AS iou FROM g JOIN f ON g.img = f.img AND "
       f"1 - {iou('g', 'f')} < 0.5 AND {overlap('g', 'f')} >= 64")
def join_iou(spark, sf):
    given, found = given_found(spark, sf)
    return regions.overlap_pairs(given, found).select(
        "img", "given", "found", "area", scalars.rounded(F.col("iou")).alias("iou")
    )


@query("join_best_region",
       f"WITH {_FOUND}, p AS (SELECT g.img AS img, g.rid AS given, f.rid AS found, {overlap('g', 'f')} AS area, "
       "g.kind = f.kind AS same FROM g JOIN f ON g.img = f.img AND "
       f"1 - {iou('g', 'f')} < 0.5 AND {overlap('g', 'f')} >= 64) "
       "SELECT img, given, found, area FROM p QUALIFY row_number() OVER "
       "(PARTITION BY img, given ORDER BY same DESC, area DESC, found) = 1")
def join_best_region(spark, sf):
    given, found = given_found(spark, sf)
    return regions.best_region(given, found)


@query("join_point_in_region",
       f"WITH {BOXES}, p AS (SELECT o_orderkey AS img, o_orderkey % 200 AS px, o_custkey % 100 AS py FROM orders) "
       "SELECT p.img AS img, min(b.rid) AS rid FROM p JOIN b ON p.img = b.img AND p.px >= b.x AND p.px < b.x + b.w "
       "AND p.py >= b.y AND p.py < b.y + b.h GROUP BY ALL")
def join_point_in_region(spark, sf):
    points = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("img"), (F.col("o_orderkey") % 200).alias("px"), (F.col("o_custkey") % 100).alias("py")
    )
    return regions.first_containing(points, boxes(spark, sf))


@query("join_precomputed",
       "SELECT d.doc_id, CAST(coalesce(l.quality, d.n_chars % 2) AS BIGINT) AS output, l.doc_id IS NULL AS computed "
       "FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_precomputed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    done = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("output"))
    return requests.reuse_outputs(
        docs, done, "doc_id", lambda todo: todo.select("doc_id", (F.col("n_chars") % 2).alias("output"))
    )


@query("join_metadata",
       "SELECT n_name AS file, r_name AS info FROM nation LEFT JOIN region ON split_part(n_name, '_', 2) = CAST(r_regionkey AS VARCHAR)")
def join_metadata(spark, sf):
    files = table(spark, sf, "nation").select(
        F.col("n_name").alias("file"), F.substring_index("n_name", "_", -1).alias("key")
    )
    meta = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("info")
    )
    return requests.attach_metadata(files, meta).select("file", "info")


@query("join_tenant",
       "SELECT c_custkey AS request, coalesce(n_name, 'Test') AS app, n_name IS NOT NULL AS valid "
       "FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) t ON c_nationkey = n_nationkey")
def join_tenant(spark, sf):
    reqs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("key")
    )
    keys = table(spark, sf, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("app")
    )
    return requests.tenant_of(reqs, keys).select("request", "app", "valid")
