"""Upserts, removals, comparison and reshaping of the item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import strings, vectors
from simloom.functions.scalars import rounded
from simloom.operators import maintenance
from simloom.plans.catalogue import query, table
from simloom.session import scratch_path
from simloom.sources import tables
from simloom.plans.inputs import E, SLICED, SLICES, items, slices


def orders(spark, sf):
    """Orders as items: current rows, and a later batch for the same and for new customers."""
    t = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"),
        F.col("o_orderstatus").alias("st"),
    )
    return t.filter("st <> 'P'").drop("st"), t.filter("st = 'P'").drop("st")


_OLD = "o AS (SELECT o_custkey AS item_id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P')"
_NEW = "n AS (SELECT o_custkey AS item_id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderstatus = 'P')"


@query("upsert", f"WITH {_OLD}, {_NEW} SELECT * FROM (FROM o UNION ALL FROM n) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) = 1")
def upsert(spark, sf):
    return maintenance.upsert(*orders(spark, sf))


@query("upsert_align", f"WITH {_OLD}, {_NEW} FROM o UNION ALL SELECT * FROM n WHERE item_id NOT IN (SELECT item_id FROM o)")
def upsert_align(spark, sf):
    return maintenance.upsert_missing(*orders(spark, sf))


@query("replace_same_id", f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE item_id % 7 = 0 OR item_id NOT IN (SELECT item_id FROM n) UNION ALL FROM n")
def replace_same_id(spark, sf):
    # One tenant (here: every seventh customer) keeps its earlier rows.
    return maintenance.replace_ids(*orders(spark, sf), exempt=F.col("item_id") % 7 == 0)


def url_items(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("item_id"), strings.derive_label(F.col("url")).alias("label"))


# Needles: whole ids of some pages, labels of others, file names of others (from their links).
_NEEDLES = (
    "i AS (SELECT page_id, url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS label, regexp_extract(url, '([^/]*)$', 1) AS file FROM pages), "
    "k AS (SELECT DISTINCT CASE page_id % 10 WHEN 1 THEN url WHEN 4 THEN label ELSE file END AS needle FROM i WHERE page_id % 10 IN (1, 4, 7)), "
    "h AS (SELECT url, CASE WHEN url = needle THEN 0 WHEN label = needle THEN 1 ELSE 2 END AS stage, needle FROM i, k WHERE needle <> '' AND (url = needle OR label = needle OR file = needle)), "
    "g AS (SELECT url FROM h QUALIFY stage = 0 OR min(stage) OVER (PARTITION BY needle) > 0)"
)


def needles(spark, sf):
    p = F.col("page_id") % 10
    url = F.col("url")
    pick = F.when(p == 1, url).when(p == 4, strings.derive_label(url)).otherwise(strings.file_name(url))
    return table(spark, sf, "pages").filter(p.isin(1, 4, 7)).select(pick.alias("needle")).filter("needle <> ''").distinct()


@query("remove_list", f"WITH {_NEEDLES} SELECT url AS item_id, label FROM i WHERE url NOT IN (SELECT url FROM g)")
def remove_list(spark, sf):
    return maintenance.remove_listed(url_items(spark, sf), needles(spark, sf))


@query("remove_count", f"WITH {_NEEDLES} SELECT CAST(count(DISTINCT url) AS BIGINT) AS removed FROM g")
def remove_count(spark, sf):
    return maintenance.matching(url_items(spark, sf), needles(spark, sf)).agg(F.countDistinct("item_id").alias("removed"))


@query("remove_batch",
       "SELECT url AS item_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 < 2)")
def remove_batch(spark, sf):
    pages = table(spark, sf, "pages")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    asked = pages.filter("page_id % 5 = 0").join(nxt, "page_id", "left").select(
        F.concat_ws("$remove$", "url", "other").alias("request")
    )
    listed = maintenance.split_needles(asked, "request", "$remove$")
    return maintenance.remove_listed(url_items(spark, sf), listed).select("item_id")


@query("clear_items", "SELECT vec_id AS item_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label <> 3")
def clear_items(spark, sf):
    path = scratch_path(spark, "clear")
    tables.save_items(items(spark, sf), path, partition_by=["label"])
    tables.clear_partition(spark, path, {"label": 3})
    return tables.load_items(spark, path).select("item_id", F.col("label").cast("bigint").alias("label"))


@query("drop_collection", "SELECT o_orderkey, o_orderstatus AS app, o_custkey % 20 AS event_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 20 = 3)")
def drop_collection(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("app"), (F.col("o_custkey") % 20).alias("event_id"))
    return maintenance.drop_collection(t, "F", 3)


@query("index_equal",
       f"WITH {E}, a AS (SELECT * FROM e WHERE id % 11 <> 3), b AS (SELECT id, CASE WHEN id % 13 = 5 THEN list_reverse(v) ELSE v END AS v FROM e WHERE id % 11 <> 4) "
       "SELECT coalesce(a.id, b.id) AS item_id, CASE WHEN b.id IS NULL THEN 'only_first' WHEN a.id IS NULL THEN 'only_second' ELSE 'value' END AS difference "
       "FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v")
def index_equal(spark, sf):
    x = items(spark, sf)
    i = F.col("item_id")
    b = x.filter(i % 11 != 4).withColumn("vec", F.when(i % 13 == 5, F.reverse("vec")).otherwise(F.col("vec")))
    return maintenance.index_difference(x.filter(i % 11 != 3), b)


_VARIANTS = (
    f"{E}, x AS (SELECT id, label, 'SELF' AS variant, v FROM e UNION ALL SELECT id, label, 'CROP v[.75]', v[1:48] FROM e UNION ALL "
    "SELECT id, label, 'ROT v[16]', list_concat(v[17:64], v[1:16]) FROM e UNION ALL SELECT id, label, 'SCALE v[2]', list_transform(v, lambda t: t * 2) FROM e)"
)


def variant_table():
    v = F.col("vec")
    return [
        ("SELF", v),
        ("CROP v[.75]", F.slice(v, 1, 48)),
        ("ROT v[16]", F.concat(F.slice(v, 17, 48), F.slice(v, 1, 16))),
        ("SCALE v[2]", F.transform(v, lambda t: t * 2)),
    ]


@query("ingest_variants",
       f"WITH {_VARIANTS} SELECT id || '/' || variant AS item_id, variant, label, CAST(len(v) AS BIGINT) AS size, round(list_sum(list_transform(v, lambda t: t * t)), 6) AS norm FROM x")
def ingest_variants(spark, sf):
    out = maintenance.variants(items(spark, sf), variant_table())
    norm = F.aggregate("vec", F.lit(0.0), lambda a, t: a + t * t)
    return out.select("item_id", "variant", "label", F.size("vec").cast("bigint").alias("size"), rounded(norm).alias("norm"))


@query("sync_ensemble",
       f"WITH {SLICED} SELECT id AS item_id, dt AS by_type, round(list_sum(v), 6) AS total, true AS same FROM s")
def sync_ensemble(spark, sf):
    long = slices(spark, sf).select("item_id", "by", "vec")
    wide = maintenance.to_wide(long, list(SLICES))
    back = maintenance.to_long(wide, list(SLICES))
    total = F.aggregate("vec", F.lit(0.0), lambda a, t: a + t)
    before = long.withColumnRenamed("vec", "_v")
    return back.join(before, ["item_id", "by"]).select(
        "item_id", F.col("by").alias("by_type"), rounded(total).alias("total"), (F.col("vec") == F.col("_v")).alias("same")
    )


_COLL = (
    "kn AS (SELECT DISTINCT o_orderstatus AS app, o_custkey % 20 AS event_id, CAST(1 AS BIGINT) AS perf FROM orders WHERE o_custkey % 20 < 8), "
    "rq AS (SELECT DISTINCT o_orderstatus AS app, o_custkey % 20 AS event_id FROM orders), "
    "al AS (SELECT app, event_id, coalesce(perf, 0) AS perf FROM rq LEFT JOIN kn USING (app, event_id))"
)


def collections(spark, sf):
    rq = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("app"), (F.col("o_custkey") % 20).alias("event_id"))
    known = rq.filter("event_id < 8").distinct().withColumn("perf", F.lit(1))
    out = maintenance.register_collections(known, rq)
    return out.withColumn("perf", F.col("perf").cast("bigint"))


@query("collection_upsert", f"WITH {_COLL} SELECT app, event_id, CAST(perf AS BIGINT) AS perf FROM al")
def collection_upsert(spark, sf):
    return collections(spark, sf)


@query("collection_list", f"WITH {_COLL} SELECT app, string_agg(event_id, ',' ORDER BY event_id) AS events, CAST(count(*) AS BIGINT) AS n FROM al GROUP BY app")
def collection_list(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda e: e.cast("string"))
    return collections(spark, sf).groupBy("app").agg(F.array_join(ids, ",").alias("events"), F.count("*").alias("n"))


@query("collection_settings",
       f"WITH {_COLL}, ch AS (SELECT o_orderstatus AS app, o_custkey % 20 AS event_id, first(o_orderkey % 4 ORDER BY o_orderkey DESC) AS p FROM orders WHERE o_orderkey % 4 < 3 GROUP BY ALL) "
       "SELECT app, event_id, CAST(coalesce(p, perf) AS BIGINT) AS perf FROM al LEFT JOIN ch USING (app, event_id)")
def collection_settings(spark, sf):
    changes = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("app"), (F.col("o_custkey") % 20).alias("event_id"),
        (F.col("o_orderkey") % 4).alias("perf"), F.col("o_orderkey").alias("seq"),
    )
    return maintenance.set_performance(collections(spark, sf), changes)
