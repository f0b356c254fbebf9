"""Column functions run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import rects, scalars, strings, vectors
from simloom.functions.scalars import rounded
from simloom.operators import aggregates
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, CENTROIDS, E, boxes, centroids, flat, iou, items, overlap, real, unit, unit01
from simloom.plans.joins import _SIG, sig_diff

def box():
    return F.col("r")


def first():
    return F.col("a")


def second():
    return F.col("c")


def lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("unit", f"SELECT l_orderkey, l_linenumber, round({unit('l_quantity')}, 6) AS u FROM lineitem")
def unit_query(spark, sf):
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", rounded(scalars.unit(F.col("l_quantity"))).alias("u")
    )


@query("real", f"SELECT l_orderkey, l_linenumber, round({real('l_discount * 9')}, 6) AS d, "
       f"round({unit(real('l_discount * 9'))}, 6) AS back FROM lineitem")
def real_query(spark, sf):
    d = scalars.real(F.col("l_discount") * 9)
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", rounded(d).alias("d"), rounded(scalars.unit(d)).alias("back")
    )


@query("unit01", f"SELECT l_orderkey, l_linenumber, round({unit01('l_quantity - 25')}, 6) AS u FROM lineitem")
def unit01_query(spark, sf):
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", rounded(scalars.unit01(F.col("l_quantity") - 25)).alias("u")
    )


@query("split_threshold",
       "SELECT event_id, CASE WHEN value - 1 >= 1 THEN CAST(floor(value - 1) AS BIGINT) END AS top_n, "
       "round(CASE WHEN value - 1 >= 0 AND value - 1 < 1 THEN value - 1 WHEN value - 1 >= 1 AND "
       "value - 1 - floor(value - 1) > 0 THEN value - 1 - floor(value - 1) END, 6) AS max_dist FROM events")
def split_threshold_query(spark, sf):
    t = F.col("value") - 1
    return table(spark, sf, "events").select(
        "event_id",
        scalars.threshold_top_n(t).alias("top_n"),
        rounded(scalars.threshold_max_dist(t)).alias("max_dist"),
    )


def against_centroid(spark, sf):
    """Every item beside the centroid of its own label (columns c and v)."""
    c = centroids(spark, sf).select(F.col("query_id").alias("label"), F.col("vec").alias("c"))
    return items(spark, sf).withColumnRenamed("vec", "v").join(c, "label")


_OWN = CENTROIDS + ", o AS (SELECT e.id AS id, c.v AS c, e.v AS v FROM e JOIN c ON c.id = e.label)"


def _sum(expr: str) -> str:
    return f"list_sum(list_transform(list_zip(c, v), lambda t: {expr}))"


@query("dist_l1", f"WITH {_OWN} SELECT id AS item_id, round({_sum('abs(t[1] - t[2])')}, 6) AS dist FROM o")
def dist_l1(spark, sf):
    d = vectors.dist_l1(F.col("c"), F.col("v"))
    return against_centroid(spark, sf).select("item_id", rounded(d).alias("dist"))


@query("dist_l2", f"WITH {_OWN} SELECT id AS item_id, round(list_distance(c, v), 6) AS dist FROM o")
def dist_l2(spark, sf):
    d = vectors.dist_l2(F.col("c"), F.col("v"))
    return against_centroid(spark, sf).select("item_id", rounded(d).alias("dist"))


@query("dist_hamming",
       f"WITH {_OWN} SELECT id AS item_id, CAST({_sum('CASE WHEN (t[1] > 0) <> (t[2] > 0) THEN 1 ELSE 0 END')} AS BIGINT) AS dist FROM o")
def dist_hamming(spark, sf):
    d = vectors.dist_hamming(vectors.pack_bits(F.col("c")), vectors.pack_bits(F.col("v")))
    return against_centroid(spark, sf).select("item_id", d.alias("dist"))


@query("dist_chi2",
       f"WITH {_OWN} SELECT id AS item_id, round({_sum('CASE WHEN t[1] <> 0 THEN (abs(t[1]) - abs(t[2])) * (abs(t[1]) - abs(t[2])) / abs(t[1]) ELSE 0 END')}, 6) AS dist FROM o")
def dist_chi2(spark, sf):
    d = vectors.dist_chi2(F.transform("c", F.abs), F.transform("v", F.abs))
    return against_centroid(spark, sf).select("item_id", rounded(d).alias("dist"))


def signatures(spark, sf, m=16):
    return items(spark, sf).select("item_id", F.array(vectors.signature(F.col("vec"), m)).alias("ch"))


def signature_pairs(spark, sf):
    """Item i beside item i + 1."""
    s = signatures(spark, sf)
    nxt = s.select((F.col("item_id") - 1).alias("item_id"), F.col("ch").alias("other"))
    return s.join(nxt, "item_id")


_NEXT = f"{_SIG} SELECT a.id AS item_id, {{}} AS dist FROM sg a JOIN sg b ON b.id = a.id + 1"


@query("dist_signature", "WITH " + _NEXT.format(f"round({sig_diff('a', 'b')}, 6)"))
def dist_signature(spark, sf):
    d = vectors.signature_diff(F.col("ch"), F.col("other"), 8)
    return signature_pairs(spark, sf).select("item_id", rounded(d).alias("dist"))


@query("dist_signature_norm",
       "WITH " + _NEXT.format(f"CASE WHEN a.a0 = b.a0 AND a.sig = b.sig THEN 0 ELSE round({unit01('0.01 * ' + sig_diff('a', 'b'))}, 6) END"))
def dist_signature_norm(spark, sf):
    d = vectors.dist_signature(F.col("ch"), F.col("other"), 8)
    return signature_pairs(spark, sf).select("item_id", rounded(d).alias("dist"))


_BOTH = f"({sig_diff('a', 'a')} + {sig_diff('b', 'b')})"
_V = f"(1 - 2 * {sig_diff('a', 'b')} / {_BOTH})"


@query("dist_signature_sym",
       "WITH " + _NEXT.format(f"round(CASE WHEN {_BOTH} = 0 THEN 1 ELSE least(1.0, {_V} * {_V}) END, 6)"))
def dist_signature_sym(spark, sf):
    d = vectors.dist_signature_sym(F.col("ch"), F.col("other"), 8)
    return signature_pairs(spark, sf).select("item_id", rounded(d).alias("dist"))


@query("signature_bin_weight",
       "WITH w(b, c0, c1, c2) AS (VALUES (0, 4.04, 15.14, 22.62), (1, 0.78, 0.92, 0.40), (2, 0.46, 0.53, 0.63), "
       "(3, 0.42, 0.26, 0.25), (4, 0.41, 0.14, 0.15), (5, 0.32, 0.07, 0.38)) "
       "SELECT l_orderkey, l_linenumber, CAST(w.b AS BIGINT) AS bin, CAST(c0 AS DOUBLE) AS w0, CAST(c1 AS DOUBLE) AS w1, "
       "CAST(c2 AS DOUBLE) AS w2 FROM lineitem JOIN w ON w.b = least(5, greatest(CAST(l_quantity AS BIGINT) // 8, CAST(l_quantity AS BIGINT) % 8))")
def signature_bin_weight(spark, sf):
    pos = F.col("l_quantity").cast("int")
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", vectors.weight_bin(pos, 8).cast("bigint").alias("bin"),
        *[vectors.bin_weight(pos, 8, c).alias(f"w{c}") for c in range(3)],
    )


@query("top_m_signature",
       f"WITH {_SIG} SELECT id AS item_id, round(a0, 6) AS average, array_to_string(sig, ' ') AS sig FROM sg")
def top_m_signature(spark, sf):
    s = F.col("ch")[0]
    return signatures(spark, sf).select(
        "item_id", rounded(s["avg"]).alias("average"), F.array_join(s["sig"].cast("array<string>"), " ").alias("sig")
    )


@query("signature_to_vector",
       f"WITH {_SIG} SELECT id AS item_id, CAST(u.pos AS BIGINT) AS pos, round(CASE WHEN u.pos = 0 THEN a0 * 255 ELSE sig[u.pos] END, 6) AS v "
       "FROM sg, (SELECT unnest(range(0, 17)) AS pos) u")
def signature_to_vector(spark, sf):
    flat_sig = vectors.signature_to_vector(F.col("ch"))
    return signatures(spark, sf).select("item_id", F.posexplode(flat_sig)).select(
        "item_id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("col")).alias("v")
    )


@query("penalise",
       f"WITH {_OWN} SELECT id AS item_id, round(CASE WHEN id % 2 = 1 THEN sqrt({unit('list_distance(c, v)')}) "
       f"ELSE {unit('list_distance(c, v)')} END, 6) AS dist FROM o")
def penalise(spark, sf):
    d = scalars.unit(vectors.dist_l2(F.col("c"), F.col("v")))
    return against_centroid(spark, sf).select(
        "item_id", rounded(scalars.penalise(d, F.col("item_id") % 2 == 1)).alias("dist")
    )


_PART = "list_distance(c[{a}:{b}], v[{a}:{b}])"
_PARTS = [unit(_PART.format(a=1 + 16 * i, b=16 * i + 16)) for i in range(4)]


def parts_of(spark, sf):
    """Four normalised distances of each item to its label's centroid, one per slice."""
    parts = F.array(*[
        scalars.unit(vectors.dist_l2(F.slice("c", 1 + 16 * i, 16), F.slice("v", 1 + 16 * i, 16))) for i in range(4)
    ])
    return against_centroid(spark, sf).select("item_id", parts.alias("parts"))


@query("ensemble_geo",
       f"WITH {_OWN}, p AS (SELECT id, {', '.join(f'{p} AS d{i}' for i, p in enumerate(_PARTS))} FROM o) "
       "SELECT id AS item_id, round(0.9565 * sqrt(sqrt(sqrt(sqrt(d0) * d1) * d2) * d3), 6) AS dist FROM p")
def ensemble_geo(spark, sf):
    return parts_of(spark, sf).select("item_id", rounded(vectors.ensemble_geo(F.col("parts"))).alias("dist"))


@query("ensemble_product",
       f"WITH {_OWN}, p AS (SELECT id, {', '.join(f'{p} AS d{i}' for i, p in enumerate(_PARTS))} FROM o) "
       "SELECT id AS item_id, round(CASE WHEN d0 * d1 * d2 * d3 = 0 THEN 0 ELSE "
       f"{unit('4.46968 * exp(0.1 * ln(d0) + 0.3 * ln(d1) + 0.6 * ln(d2) + 0.9 * ln(d3))')} END, 6) AS dist FROM p")
def ensemble_product(spark, sf):
    d = vectors.ensemble_product(F.col("parts"), [0.1, 0.3, 0.6, 0.9])
    return parts_of(spark, sf).select("item_id", rounded(d).alias("dist"))


# Rectangles: each beside a copy of itself moved by amounts derived from its id.
_PAIR = BOXES + (
    ", p AS (SELECT *, x + rid % 7 AS ox, y + rid % 5 AS oy, w - rid % 4 AS ow, h AS oh FROM b), "
    "q AS (SELECT rid, {'x': x, 'y': y, 'w': w, 'h': h} AS a, {'x': ox, 'y': oy, 'w': ow, 'h': oh} AS c FROM p)"
)


def rect_pairs(spark, sf):
    i = F.col("rid")
    other = rects.rect(
        box()["x"] + (i % 7).cast("int"), box()["y"] + (i % 5).cast("int"), box()["w"] - (i % 4).cast("int"), box()["h"]
    )
    return boxes(spark, sf).select("rid", box().alias("a"), other.alias("c"))


@query("rect_iou",
       f"WITH {_PAIR} SELECT rid, round({iou('a', 'c')}, 6) AS iou, {overlap('a', 'c')} > 0 AND 1 - {iou('a', 'c')} < 0.5 AS matches FROM q")
def rect_iou(spark, sf):
    return rect_pairs(spark, sf).select("rid", rounded(rects.iou(first(), second())).alias("iou"), rects.overlaps(first(), second()).alias("matches"))


@query("rect_intersect",
       f"WITH {_PAIR} SELECT rid, greatest(a.x, c.x) AS x, greatest(a.y, c.y) AS y, "
       "least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x) AS w, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) AS h FROM q "
       f"WHERE {overlap('a', 'c')} > 0 UNION ALL SELECT rid, 0, 0, 0, 0 FROM q WHERE {overlap('a', 'c')} = 0")
def rect_intersect(spark, sf):
    return flat(rect_pairs(spark, sf).withColumn("r", rects.intersect(first(), second())), "rid")


@query("rect_union",
       f"WITH {_PAIR} SELECT rid, least(a.x, c.x) AS x, least(a.y, c.y) AS y, "
       "greatest(a.x + a.w, c.x + c.w) - least(a.x, c.x) AS w, greatest(a.y + a.h, c.y + c.h) - least(a.y, c.y) AS h FROM q")
def rect_union(spark, sf):
    return flat(rect_pairs(spark, sf).withColumn("r", rects.union(first(), second())), "rid")


def _even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


@query("rect_average",
       f"WITH {_PAIR} SELECT rid, " + ", ".join(f"{_even(f'(a.{k} + c.{k}) * 0.5')} AS {k}" for k in "xywh") + " FROM q")
def rect_average(spark, sf):
    return flat(rect_pairs(spark, sf).withColumn("r", rects.average(first(), second())), "rid")


@query("rect_contains",
       f"WITH {_PAIR} SELECT rid, a.x >= c.x AND a.y >= c.y AND a.x + a.w <= c.x + c.w AND a.y + a.h <= c.y + c.h AS a_in_c, "
       "c.x >= a.x AND c.y >= a.y AND c.x + c.w <= a.x + a.w AND c.y + c.h <= a.y + a.h AS c_in_a FROM q")
def rect_contains(spark, sf):
    return rect_pairs(spark, sf).select("rid", rects.contains(first(), second()).alias("a_in_c"), rects.contains(second(), first()).alias("c_in_a"))


@query("rect_overlap_mean",
       f"WITH {_PAIR} SELECT rid, round({overlap('a', 'c')} / ((a.w * a.h + c.w * c.h) / 2), 6) AS share FROM q")
def rect_overlap_mean(spark, sf):
    return rect_pairs(spark, sf).select("rid", rounded(rects.overlap_mean(first(), second())).alias("share"))


@query("rect_stretch",
       f"WITH {BOXES}, s AS (SELECT *, CAST(trunc(w * 1.2) AS BIGINT) AS nw, CAST(trunc(h * 0.8) AS BIGINT) AS nh FROM b) "
       "SELECT rid, CAST(trunc(x + (w - nw) / 2.0) AS BIGINT) AS x, CAST(trunc(y + (h - nh) / 2.0) AS BIGINT) AS y, nw AS w, nh AS h FROM s")
def rect_stretch(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.stretch(box(), 1.2, 0.8)), "rid")


@query("rect_scale", f"WITH {BOXES} SELECT rid, " + ", ".join(f"{_even(f'{k} * 0.75')} AS {k}" for k in "xywh") + " FROM b")
def rect_scale(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.scale(box(), 0.75)), "rid")


@query("rect_shift", f"WITH {BOXES} SELECT rid, x + 5 AS x, y - 3 AS y, w, h FROM b")
def rect_shift(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.shift(box(), 5, -3)), "rid")


@query("rect_clip",
       f"WITH {BOXES}, f AS (SELECT {{'x': 20, 'y': 10, 'w': 120, 'h': 60}} AS f, b.* FROM b), "
       "k AS (SELECT rid, greatest(x, 20) AS x, greatest(y, 10) AS y, least(x + w, 140) - greatest(x, 20) AS w, "
       "least(y + h, 70) - greatest(y, 10) AS h FROM b) "
       "SELECT rid, CASE WHEN w > 0 AND h > 0 THEN x ELSE 0 END AS x, CASE WHEN w > 0 AND h > 0 THEN y ELSE 0 END AS y, "
       "CASE WHEN w > 0 AND h > 0 THEN w ELSE 0 END AS w, CASE WHEN w > 0 AND h > 0 THEN h ELSE 0 END AS h FROM k")
def rect_clip(spark, sf):
    frame = rects.rect(F.lit(20), F.lit(10), F.lit(120), F.lit(60))
    return flat(boxes(spark, sf).withColumn("r", rects.intersect(box(), frame)), "rid")


_M = [[0.5, 1.0, 3.0], [-1.0, 0.5, 40.0]]


def _image(m: list[float], x: str, y: str) -> str:
    return f"CAST(trunc({m[0]} * ({x}) + {m[1]} * ({y}) + {m[2]}) AS BIGINT)"


_CORNERS = [("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h")]
_PX = ", ".join(_image(_M[0], *c) for c in _CORNERS)
_PY = ", ".join(_image(_M[1], *c) for c in _CORNERS)


@query("rect_affine",
       f"WITH {BOXES}, k AS (SELECT rid, least(x, {_PX}) AS l, least(y, {_PY}) AS t, greatest(x + w, {_PX}) AS rr, greatest(y + h, {_PY}) AS bb FROM b) "
       "SELECT rid, l AS x, t AS y, rr - l AS w, bb - t AS h FROM k")
def rect_affine(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.affine(box(), _M)), "rid")


@query("rect_rotate",
       f"WITH {BOXES}, k AS (SELECT *, {_even('x + w * 0.5')} AS cx, {_even('y + h * 0.5')} AS cy FROM b) "
       "SELECT rid, CAST(trunc(0.5 * cx + cy + 3.0 - w // 2) AS BIGINT) AS x, CAST(trunc(-1.0 * cx + 0.5 * cy + 40.0 - h // 2) AS BIGINT) AS y, w, h FROM k")
def rect_rotate(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.rotate(box(), _M)), "rid")


@query("rect_turn",
       f"WITH {BOXES}, k AS (SELECT *, rid % 4 AS p FROM b) SELECT rid, "
       "CASE p WHEN 1 THEN y WHEN 2 THEN 300 - (x + w) WHEN 3 THEN 300 - (y + h) ELSE x END AS x, "
       "CASE p WHEN 1 THEN 260 - (x + w) WHEN 2 THEN 260 - (y + h) WHEN 3 THEN x ELSE y END AS y, "
       "CASE WHEN p IN (1, 3) THEN h ELSE w END AS w, CASE WHEN p IN (1, 3) THEN w ELSE h END AS h, true AS restored FROM k")
def rect_turn(spark, sf):
    turned = rects.turn(box(), F.col("rid") % 4, 300, 260)
    df = boxes(spark, sf).withColumn("t", turned)
    # A turn inside the parent it came from and its inverse give the rectangle back.
    odd = (F.col("rid") % 4).isin(1, 3)
    pw, ph = F.when(odd, 260).otherwise(300), F.when(odd, 300).otherwise(260)
    back = rects.unturn(rects.turn(box(), F.col("rid") % 4, pw, ph), F.col("rid") % 4, pw, ph)
    return df.select("rid", *[F.col(f"t.{k}").cast("bigint").alias(k) for k in "xywh"], (back == box()).alias("restored"))


@query("rect_center", f"WITH {BOXES} SELECT rid, {_even('x + w * 0.5')} AS cx, {_even('y + h * 0.5')} AS cy FROM b")
def rect_center(spark, sf):
    c = rects.center(box())
    return boxes(spark, sf).select("rid", c["x"].cast("bigint").alias("cx"), c["y"].cast("bigint").alias("cy"))


@query("rect_diameter", f"WITH {BOXES} SELECT rid, greatest(w, h) AS diameter FROM b")
def rect_diameter(spark, sf):
    return boxes(spark, sf).select("rid", rects.diameter(box()).cast("bigint").alias("diameter"))


@query("rect_aspect", f"WITH {BOXES} SELECT rid, round(w / h, 6) AS aspect, round(least(w / h, h / w), 6) AS level FROM b")
def rect_aspect(spark, sf):
    return boxes(spark, sf).select("rid", rounded(rects.aspect(box())).alias("aspect"), rounded(rects.aspect_unit(box())).alias("level"))


@query("region_from_points",
       f"WITH {BOXES}, k AS (SELECT rid, x, y, x + w AS x2, y + h AS y2, sqrt(w * w + h * h) AS g FROM b), "
       f"o AS (SELECT *, {_even('(x + x2) * 0.5')} - CAST(trunc(g * 2.5 / 2) AS BIGINT) AS ox, "
       f"{_even('(y + y2) * 0.5')} - CAST(trunc(g * 2.5 / 3) AS BIGINT) AS oy FROM k) "
       "SELECT rid, ox AS x, oy AS y, CAST(trunc(g * 2.5) AS BIGINT) AS size, x - CAST(trunc(g * 0.6 / 2) AS BIGINT) - ox AS left_x, "
       "y - CAST(trunc(g * 0.6 / 2) AS BIGINT) - oy AS left_y, CAST(trunc(g * 0.6) AS BIGINT) AS left_size, "
       "CAST(CASE WHEN x <> 0 OR y2 <> 0 THEN 3 ELSE 2 END AS BIGINT) AS subs FROM o")
def region_from_points(spark, sf):
    left = F.struct(box()["x"].alias("x"), box()["y"].alias("y"))
    right = F.struct((box()["x"] + box()["w"]).alias("x"), (box()["y"] + box()["h"]).alias("y"))
    nose = F.struct(box()["x"].alias("x"), (box()["y"] + box()["h"]).alias("y"))
    mouth = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    g = rects.region_from_points(left, right, nose, mouth)
    df = boxes(spark, sf).select("rid", g.alias("g"))
    eye = F.col("g.subs")[0]
    big = lambda c: c.cast("bigint")
    return df.select(
        "rid", big(F.col("g.x")).alias("x"), big(F.col("g.y")).alias("y"), big(F.col("g.w")).alias("size"),
        big(eye["x"]).alias("left_x"), big(eye["y"]).alias("left_y"), big(eye["w"]).alias("left_size"),
        F.size("g.subs").cast("bigint").alias("subs"),
    )


@query("inflate_clip",
       f"WITH {BOXES}, k AS (SELECT *, CAST(floor(({_even('w * 1.3')} - w) / 2) AS BIGINT) AS dx, CAST(floor(({_even('h * 1.3')} - h) / 2) AS BIGINT) AS dy FROM b), "
       "c AS (SELECT rid, greatest(x - dx, 0) AS x, greatest(y - dy, 0) AS y, least(x + w + dx, 220) AS r, least(y + h + dy, 110) AS t FROM k) "
       "SELECT rid, x, y, r - x AS w, t - y AS h FROM c")
def inflate_clip(spark, sf):
    return flat(boxes(spark, sf).withColumn("r", rects.inflate_clip(box(), 0.3, F.lit(220), F.lit(110))), "rid")


@query("string_tools",
       r"""SELECT doc_id, trim(text, E' \t\r\n.') AS trimmed, lower(source) AS folded, starts_with(text, 'The') AS prefixed,
       ends_with(text, '.') AS suffixed, contains(text, 'the') AS found, CAST(length(replace(text, 'th', '')) AS BIGINT) AS replaced,
       regexp_matches(source, '^[0-9]+$') AS num, regexp_replace(replace(source || '/' || lang, '/', 'SLASH'), '[:*?"<>|]', '_', 'g') AS safe,
       CAST(length(text) - length(replace(text, E'\n', '')) + 1 AS BIGINT) AS lines FROM documents""")
def string_tools(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        strings.trimmed(t, " \t\r\n.").alias("trimmed"),
        F.lower("source").alias("folded"),
        t.startswith("The").alias("prefixed"),
        t.endswith(".").alias("suffixed"),
        t.contains("the").alias("found"),
        F.length(F.replace(t, F.lit("th"), F.lit(""))).cast("bigint").alias("replaced"),
        strings.is_numeric(F.col("source")).alias("num"),
        strings.safe_name(F.concat_ws("/", "source", "lang")).alias("safe"),
        strings.line_count(t).alias("lines"),
    )


@query("unit_vec_stats",
       f"WITH {E} SELECT label, CAST(g.pos - 1 AS BIGINT) AS pos, round(avg(v[g.pos]), 6) AS mean FROM e, "
       "(SELECT unnest(range(1, 65)) AS pos) g GROUP BY ALL")
def unit_vec_stats(spark, sf):
    return aggregates.mean_vector(items(spark, sf), "label").withColumn("pos", F.col("pos").cast("bigint"))
