"""Geometry of regions with two levels of children: every box (``r``) has two children (``a``, ``b``) of one child each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.plans.catalogue import query
from simloom.plans.inputs import BOXES, boxes

SIDES = ("x", "y", "w", "h")


def trees(spark, sf):
    """(rid, r) with ``r`` as STRUCT<x, y, w, h, subs>; children may stick out of their parents."""
    i, r = F.col("rid"), F.col("r")

    def part(name: str, x, y, w, h, subs: Column | None = None) -> Column:
        fields = [F.lit(name).alias("name"), *[v.cast("int").alias(k) for k, v in zip(SIDES, (x, y, w, h))]]
        return F.struct(*fields, *([subs.alias("subs")] if subs is not None else []))

    def child(name: str, x, y, w, h) -> Column:
        below = F.array(part("g", i % 5 - 1, i % 3 - 1, F.floor(w / 2), F.floor(h / 2)))
        return part(name, x, y, w, h, below)

    subs = F.array(
        child("a", i % 11 - 4, i % 7 - 2, F.floor(r["w"] / 2), F.floor(r["h"] / 3)),
        child("b", r["w"] - i % 9, r["h"] - i % 5, F.lit(6), F.lit(6)),
    )
    return boxes(spark, sf).select("rid", r.withField("subs", subs).alias("r"))


def listed(df):
    """A row per region of a tree, with the names on the way to it."""
    def row(path: Column, r: Column) -> Column:
        return F.struct(path.alias("path"), *[r[k].cast("bigint").alias(k) for k in SIDES])

    r = F.col("r")
    below = F.transform(r["subs"], lambda s: F.concat(
        F.array(row(s["name"], s)), F.transform(s["subs"], lambda g: row(F.concat(s["name"], g["name"]), g))))
    return df.select("rid", F.inline(F.concat(F.array(row(F.lit("r"), r)), F.flatten(below))))


def tree_sql(own: list[str], inner: list[str] | None = None, move: tuple[str, str] = ("x", "y"),
             back: tuple[str, str] = ("ox", "oy"), keep: str = "true") -> str:
    """Level by level: children (x, y, w, h) of a parent (original px.., new pox..) are moved, become (ox, oy, ow, oh)
    by ``inner`` and are listed after ``back``."""
    def new(exprs: list[str]) -> str:
        return ", ".join(f"CAST({e} AS BIGINT) AS o{k}" for k, e in zip(SIDES, exprs))

    def level(source: str) -> str:
        return (f"SELECT *, {new(inner or own)} FROM (SELECT rid, path, {move[0]} AS x, {move[1]} AS y, w, h, px, py, pox, poy, pow, poh FROM {source})")

    old = "x AS px, y AS py, ox AS pox, oy AS poy, ow AS pow, oh AS poh"
    return (
        f"WITH {BOXES}, l0 AS (SELECT rid, x, y, w, h, {new(own)} FROM b), "
        f"s1 AS (SELECT rid, 'a' AS path, rid % 11 - 4 AS x, rid % 7 - 2 AS y, w // 2 AS w, h // 3 AS h, {old} FROM l0 "
        f"UNION ALL SELECT rid, 'b', w - rid % 9, h - rid % 5, 6, 6, {old} FROM l0), "
        f"l1 AS (SELECT * FROM ({level('s1')}) WHERE {keep}), "
        f"s2 AS (SELECT rid, path || 'g' AS path, rid % 5 - 1 AS x, rid % 3 - 1 AS y, w // 2 AS w, h // 2 AS h, {old} FROM l1), "
        f"l2 AS (SELECT * FROM ({level('s2')}) WHERE {keep}) "
        "SELECT rid, 'r' AS path, ox AS x, oy AS y, ow AS w, oh AS h FROM l0 UNION ALL "
        f"SELECT rid, path, {back[0]}, {back[1]}, ow, oh FROM (FROM l1 UNION ALL FROM l2)"
    )


_KEPT_PLACE = ("x + px - pox", "y + py - poy")
_IN_IMAGE, _IN_PARENT = ("x + px", "y + py"), ("ox - pox", "oy - poy")


@query("rect_stretch_nested",
       tree_sql(["trunc(x + (w - trunc(w * 1.2)) / 2.0)", "trunc(y + (h - trunc(h * 0.8)) / 2.0)", "trunc(w * 1.2)", "trunc(h * 0.8)"],
                move=_KEPT_PLACE))
def rect_stretch_nested(spark, sf):
    return listed(trees(spark, sf).withColumn("r", rects.stretch_all(F.col("r"), 1.2, 0.8, depth=2)))


@query("rect_scale_nested", tree_sql([f"round_even({k} * 0.75, 0)" for k in SIDES]))
def rect_scale_nested(spark, sf):
    return listed(trees(spark, sf).withColumn("r", rects.scale_all(F.col("r"), 0.75, depth=2)))


def _clip(x: str, y: str, right: str, low: str) -> list[str]:
    w, h = f"least(x + w, {right}) - greatest(x, {x})", f"least(y + h, {low}) - greatest(y, {y})"
    return [f"CASE WHEN {w} > 0 AND {h} > 0 THEN {v} ELSE 0 END" for v in (f"greatest(x, {x})", f"greatest(y, {y})", w, h)]


@query("rect_clip_nested",
       tree_sql(_clip("20", "10", "140", "70"), _clip("0", "0", "pow", "poh"), move=_KEPT_PLACE, keep="ow > 0"))
def rect_clip_nested(spark, sf):
    frame = rects.rect(F.lit(20), F.lit(10), F.lit(120), F.lit(60))
    return listed(trees(spark, sf).withColumn("r", rects.clip_all(F.col("r"), frame, depth=2)))


_M = [[0.5, 1.0, 3.0], [-1.0, 0.5, 40.0]]
_CORNERS = [(x, y) for x in ("x", "x + w") for y in ("y", "y + h")]
_PX, _PY = (", ".join(f"trunc({m[0]} * ({x}) + {m[1]} * ({y}) + {m[2]})" for x, y in _CORNERS) for m in _M)
_LEFT, _TOP, _RIGHT, _LOW = f"least(x, {_PX})", f"least(y, {_PY})", f"greatest(x + w, {_PX})", f"greatest(y + h, {_PY})"


@query("rect_affine_nested", tree_sql([_LEFT, _TOP, f"{_RIGHT} - {_LEFT}", f"{_LOW} - {_TOP}"], move=_IN_IMAGE, back=_IN_PARENT))
def rect_affine_nested(spark, sf):
    return listed(trees(spark, sf).withColumn("r", rects.affine_all(F.col("r"), _M, depth=2)))


_CX, _CY = "round_even(x + w * 0.5, 0)", "round_even(y + h * 0.5, 0)"


@query("rect_rotate_nested",
       tree_sql([f"trunc(0.5 * {_CX} + {_CY} + 3.0 - w // 2)", f"trunc(-1.0 * {_CX} + 0.5 * {_CY} + 40.0 - h // 2)", "w", "h"],
                move=_IN_IMAGE, back=_IN_PARENT))
def rect_rotate_nested(spark, sf):
    return listed(trees(spark, sf).withColumn("r", rects.rotate_all(F.col("r"), _M, depth=2)))


def _turn(w: str, h: str) -> list[str]:
    return [
        f"CASE rid % 4 WHEN 1 THEN y WHEN 2 THEN {w} - (x + w) WHEN 3 THEN {w} - (y + h) ELSE x END",
        f"CASE rid % 4 WHEN 1 THEN {h} - (x + w) WHEN 2 THEN {h} - (y + h) WHEN 3 THEN x ELSE y END",
        "CASE WHEN rid % 2 = 1 THEN h ELSE w END", "CASE WHEN rid % 2 = 1 THEN w ELSE h END",
    ]


@query("rect_turn_nested", tree_sql(_turn("300", "260"), _turn("pow", "poh")))
def rect_turn_nested(spark, sf):
    return listed(trees(spark, sf).withColumn("r", rects.turn_all(F.col("r"), F.col("rid") % 4, F.lit(300), F.lit(260), depth=2)))


@query("rect_unturn_nested",
       f"WITH {BOXES}, l1 AS (SELECT rid, x, y, w, h FROM b) SELECT rid, true AS restored FROM l1")
def rect_unturn_nested(spark, sf):
    """A turn with all children in a parent of 300 x 260 and its inverse give the tree back."""
    phase, r = F.col("rid") % 4, F.col("r")
    odd = phase.isin(1, 3)
    w, h = F.when(odd, 260).otherwise(300), F.when(odd, 300).otherwise(260)
    turned = trees(spark, sf).withColumn("t", rects.turn_all(r, phase, w, h, depth=2))
    back = rects.unturn_all(F.col("t"), phase, w, h, depth=2)
    return turned.select("rid", (back == r).alias("restored"))
