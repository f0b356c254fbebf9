"""Merging and clean-up of rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.functions.scalars import rounded
from simloom.operators import regions
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, boxes, flat, iou, overlap


def box():
    return F.col("r")


FACES = (
    BOXES + ", f AS (SELECT * FROM b WHERE kind = 'f'), pf AS (SELECT * FROM b WHERE kind = 'p')"
)


def merged(spark, sf, mode="avg", **how):
    listed = boxes(spark, sf).withColumn("line", F.expr("rid div 1000000000000000"))
    out = regions.merge_regions(listed, mode, **how)
    return out.select("img", "rid", "kind", *[F.col(f"r.{k}").cast("bigint").alias(k) for k in "xywh"], F.col("n").cast("bigint").alias("n"))


@query("merge_regions")
def merge_regions(spark, sf):
    out = None
    for mode in ("avg", "min", "max"):
        one = merged(spark, sf, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query("union_regions")
def union_regions(spark, sf):
    """Lists of one image in line order: every region is added to what is there."""
    return merged(spark, sf)


@query("intersect_regions")
def intersect_regions(spark, sf):
    """Lists of one image in line order: those after the first only add what meets a region that is there."""
    return merged(spark, sf, meet=True)


@query("last_regions",
       f"WITH {BOXES} SELECT img, rid FROM b JOIN (SELECT img, max(rid // 1000000000000000) AS line FROM b GROUP BY img) l USING (img) WHERE rid // 1000000000000000 = line")
def last_regions(spark, sf):
    listed = boxes(spark, sf).withColumn("line", F.expr("rid div 1000000000000000"))
    return regions.last_list(listed).select("img", "rid")


@query("merge_attributes",
       "SELECT c_nationkey, c_mktsegment AS kind, first(c_name ORDER BY c_custkey DESC) AS value FROM customer GROUP BY ALL")
def merge_attributes(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("kind")).agg(
        F.max_by("c_name", "c_custkey").alias("value")
    )


def _inside(a: str, b: str) -> str:
    return f"({a}.x >= {b}.x AND {a}.y >= {b}.y AND {a}.x + {a}.w <= {b}.x + {b}.w AND {a}.y + {a}.h <= {b}.y + {b}.h)"


@query("merge_pairs_simple")
def merge_pairs_simple(spark, sf):
    return flat(regions.merge_pairs_simple(boxes(spark, sf)), "img", "rid")


def parents(spark, sf):
    """Each box with two sub-boxes in its own coordinates, partly sticking out."""
    i = F.col("rid")
    subs = F.array(
        rects.rect((i % 11 - 4).cast("int"), (i % 7 - 2).cast("int"), (box()["w"] / 2).cast("int"), (box()["h"] / 3).cast("int")),
        rects.rect((box()["w"] - i % 9).cast("int"), (box()["h"] - i % 5).cast("int"), F.lit(6), F.lit(6)),
    )
    return boxes(spark, sf).withColumn("subs", subs)


_SUBS = (
    BOXES + ", s1 AS (SELECT *, rid % 11 - 4 AS ax, rid % 7 - 2 AS ay, w // 2 AS aw, h // 3 AS ah, w - rid % 9 AS bx, h - rid % 5 AS by_ FROM b)"
)


@query("enclose_children",
       f"WITH {_SUBS}, e AS (SELECT *, least(0, ax, bx) AS x0, least(0, ay, by_) AS y0, greatest(w, ax + aw, bx + 6) AS x1, greatest(h, ay + ah, by_ + 6) AS y1 FROM s1) "
       "SELECT rid, x + x0 AS x, y + y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM e")
def enclose_children(spark, sf):
    df = parents(spark, sf)
    return flat(df.withColumn("r", rects.enclose(box(), F.col("subs"))), "rid")


@query("crop_children",
       f"WITH {_SUBS}, c AS (SELECT rid, 0 AS pos, greatest(ax, 0) AS x, greatest(ay, 0) AS y, least(ax + aw, w) - greatest(ax, 0) AS w, least(ay + ah, h) - greatest(ay, 0) AS h FROM s1 "
       "UNION ALL SELECT rid, 1, greatest(bx, 0), greatest(by_, 0), least(bx + 6, w) - greatest(bx, 0), least(by_ + 6, h) - greatest(by_, 0) FROM s1) "
       "SELECT rid, x, y, w, h FROM c WHERE w > 0 AND h > 0")
def crop_children(spark, sf):
    df = parents(spark, sf).select("rid", F.explode(rects.crop_subs(box(), F.col("subs"))).alias("r"))
    return flat(df, "rid")


@query("clip_regions",
       f"WITH {BOXES}, k AS (SELECT img, rid, x, y, least(x + w, 60 + o_custkey % 150) - x AS w, least(y + h, 30 + o_custkey % 80) - y AS h FROM b JOIN orders ON img = o_orderkey) "
       "SELECT img, rid, x, y, w, h FROM k WHERE w > 0 AND h > 0")
def clip_regions(spark, sf):
    c = F.col("o_custkey")
    bounds = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("img"), (c % 150 + 60).cast("int").alias("bw"), (c % 80 + 30).cast("int").alias("bh")
    )
    return flat(regions.clip_regions(boxes(spark, sf), bounds), "img", "rid")


@query("assign_region_ids",
       f"WITH {BOXES}, l AS (SELECT *, CASE WHEN rid % 3 = 0 THEN 'own' || rid END AS own FROM b), "
       "n AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY rid) AS n FROM l WHERE own IS NULL) "
       "SELECT img, rid, own AS region_id FROM l WHERE own IS NOT NULL UNION ALL "
       "SELECT img, rid, 'img' || img || CASE WHEN n = 1 THEN '' ELSE '.' || (n - 1) END FROM n")
def assign_region_ids(spark, sf):
    df = boxes(spark, sf).select(
        "img", "rid", F.concat(F.lit("img"), F.col("img")).alias("base"),
        F.when(F.col("rid") % 3 == 0, F.concat(F.lit("own"), F.col("rid"))).alias("region_id"),
    )
    return regions.assign_ids(df, "base").select("img", "rid", "region_id")


def _even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


@query("rescale_roundtrip",
       f"WITH {BOXES}, s AS (SELECT rid, " + ", ".join(f"{k} AS o{k}, {_even(f'{k} * 0.3')} AS {k}" for k in "xywh") + " FROM b), "
       "k AS (SELECT *, " + ", ".join(f"{_even(f'{k} * (1 / 0.3)')} AS b_{k}" for k in "xywh") + " FROM s) "
       "SELECT rid, " + ", ".join(f"b_{k} AS {k}" for k in "xywh") + ", b_x = ox AND b_y = oy AND b_w = ow AND b_h = oh AS exact FROM k")
def rescale_roundtrip(spark, sf):
    back = rects.scale(rects.scale(box(), 0.3), 1 / 0.3)
    df = boxes(spark, sf).withColumn("back", back)
    return df.select("rid", *[F.col(f"back.{k}").cast("bigint").alias(k) for k in "xywh"], (F.col("back") == box()).alias("exact"))


@query("resolve_conflict_subs",
       f"WITH {BOXES}, n AS (SELECT * FROM b WHERE status = 'O'), o AS (SELECT * FROM b WHERE status = 'F') "
       f"SELECT img, rid FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.img = o.img AND n.kind <> o.kind AND 1 - {iou('n', 'o')} < 0.7 AND {overlap('n', 'o')} >= 64)")
def resolve_conflict_subs(spark, sf):
    b = boxes(spark, sf)
    return regions.evict_conflicts(b.filter("status = 'O'"), b.filter("status = 'F'"), tol=0.7).select("img", "rid")


def sub_lists(spark, sf):
    """Each box with a short array of sub-regions."""
    kinds = F.array(*map(F.lit, "nmie"))
    subs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("rid") % 5),
        lambda i: F.struct(F.element_at(kinds, ((F.col("rid") + i) % 4 + 1).cast("int")).alias("kind")),
    )
    return boxes(spark, sf).select("img", "rid", subs.alias("subs"))


_KIND = "(SELECT img, rid, ['n', 'm', 'i', 'e'][(rid + u.i) % 4 + 1] AS kind FROM b, (SELECT unnest(range(0, 5)) AS i) u WHERE u.i <= rid % 5)"


@query("count_kinds", f"WITH {BOXES} SELECT img, rid, CAST(count(*) FILTER (WHERE kind IN ('i', 'e')) AS BIGINT) AS n FROM {_KIND} GROUP BY ALL")
def count_kinds(spark, sf):
    return sub_lists(spark, sf).select("img", "rid", rects.count_kinds(F.col("subs"), "i", "e").alias("n"))


@query("has_kind", f"WITH {BOXES} SELECT img, rid, bool_or(kind = 'e') AS has FROM {_KIND} GROUP BY ALL")
def has_kind(spark, sf):
    return sub_lists(spark, sf).select("img", "rid", rects.has_kind(F.col("subs"), "e").alias("has"))
