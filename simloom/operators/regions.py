"""Annotated rectangles: overlap joins, one-to-one matching, merging and clean-up.

Tables carry (img, rid, kind, r) with r STRUCT<x, y, w, h>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import rects
from simloom.operators.prefix import numbered, running
from simloom.operators.region_merge import merged_batches
from simloom.session import cut

GRID = 64
#: Pairs of an image that one row may hold.
IMAGE_PAIRS = 1000
PART_ROWS = 10_000


def _tiled(df: DataFrame, grid: int) -> DataFrame:
    """One row per grid tile (tx, ty) that a rectangle touches."""
    for axis, size in (("x", "w"), ("y", "h")):
        low, far = F.col(f"r.{axis}"), F.col(f"r.{axis}") + F.col(f"r.{size}") - 1
        df = df.filter(F.col(f"r.{size}") > 0).withColumn(
            f"t{axis}", F.explode(F.sequence(F.floor(low / grid), F.floor(far / grid)))
        )
    return df


def _side(df: DataFrame, rid: str, c: str, grid: int) -> DataFrame:
    """Tiled rectangles; what follows from them is added behind the shuffle."""
    ready = _tiled(df.select("img", F.col("rid").alias(rid), F.col("kind").alias(f"{rid}_kind"), "r"), grid)
    return ready.select("img", "tx", "ty", rid, f"{rid}_kind", F.col("r").alias(f"{c}r"))


def _edges(c: str) -> dict[str, Column]:
    r = F.col(f"{c}r")
    return {f"{c}x": r["x"], f"{c}x2": r["x"] + r["w"], f"{c}y": r["y"], f"{c}y2": r["y"] + r["h"], f"{c}_area": rects.area(r)}


def touching(a: DataFrame, b: DataFrame, grid: int = GRID) -> DataFrame:
    """Pairs of one image that share area (column ``area``), each once.

    Rectangles meet per grid tile, so an image with very many of them spreads over its tiles; the
    tile holding the corner of the common area reports the pair.
    """
    # The estimate of a side does not see its tiles: ask for the join that splits and spills.
    met = _side(a, "given", "g", grid).join(_side(b, "found", "f", grid).hint("merge"), ["img", "tx", "ty"])
    met = met.withColumns({**_edges("g"), **_edges("f")})
    left, right = F.greatest("gx", "fx"), F.least("gx2", "fx2")
    top, bottom = F.greatest("gy", "fy"), F.least("gy2", "fy2")
    edges = [f"{c}{e}" for c in "gf" for e in ("x", "x2", "y", "y2")]
    return met.filter(
        (F.floor(left / grid) == F.col("tx")) & (F.floor(top / grid) == F.col("ty")) & (left < right) & (top < bottom)
    ).withColumn("area", (right - left).cast("bigint") * (bottom - top)).drop("tx", "ty", *edges)


def overlap_pairs(given: DataFrame, found: DataFrame, tol: float = rects.MATCH_TOLERANCE,
                  min_dim: int = rects.MIN_DIMENSION, grid: int = GRID) -> DataFrame:
    """Pairs with 1 - IoU under the tolerance and a common area of at least min_dim squared."""
    return (
        touching(given, found, grid)
        .filter(F.col("area") >= min_dim * min_dim)
        .withColumn("iou", F.try_divide("area", F.col("g_area") + F.col("f_area") - F.col("area")))
        .filter(1 - F.col("iou") < tol)
        .withColumn("same", F.col("given_kind") == F.col("found_kind"))
        .drop("g_area", "f_area")
    )


def best_region(given: DataFrame, found: DataFrame, **how) -> DataFrame:
    """Best match of each given region: same kind first, then the largest overlap."""
    key = F.struct(F.col("same"), F.col("area"), (-F.col("found")).alias("o"))
    return (
        overlap_pairs(given, found, **how)
        .groupBy("img", "given")
        .agg(F.max(F.struct(key.alias("k"), F.col("found"), F.col("area"))).alias("b"))
        .select("img", "given", F.col("b.found").alias("found"), F.col("b.area").alias("area"))
    )


def first_containing(points: DataFrame, regions: DataFrame, grid: int = GRID) -> DataFrame:
    """Lowest region id that contains each point (img, px, py)."""
    at = points.withColumn("tx", F.floor(F.col("px") / grid)).withColumn("ty", F.floor(F.col("py") / grid))
    return (
        at.join(_tiled(regions, grid), ["img", "tx", "ty"])
        .filter(rects.contains_point(F.col("r"), F.col("px"), F.col("py")))
        .groupBy(*points.columns)
        .agg(F.min("rid").alias("rid"))
        .select("img", "rid")
    )


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Each given region, in id order, takes its best found region that is still free.

    The pairs of an image become one row, in which the regions choose in turn; images of more than IMAGE_PAIRS pairs
    are solved by proposals. ``pairs``: img, given, found, same, area, ...
    """
    left = cut(pairs)
    large = cut(left.groupBy("img").count().filter(F.col("count") > IMAGE_PAIRS).select("img"))
    if large.isEmpty():
        return _in_turn(left)
    return _in_turn(left.join(large, "img", "left_anti")).unionByName(_by_proposals(left.join(large, "img", "left_semi")))


def _in_turn(pairs: DataFrame) -> DataFrame:
    """``one_to_one`` for images whose pairs fit one row. A candidate without an id takes a region out without a pair."""
    same = F.when(F.col("same"), 0).when(~F.col("same"), 1).otherwise(2)
    entry = F.struct(
        "given", same.alias("_s"), (-F.col("area")).alias("_a"), F.col("found").isNull().alias("_n"), "found", F.struct(*pairs.columns).alias("row"))
    ids = dict(pairs.select("given", "found").dtypes)
    start = F.struct(
        F.lit(None).cast(ids["given"]).alias("last"),
        F.array().cast(f"array<{ids['found']}>").alias("used"),
        F.array().cast(f"array<struct<given:{ids['given']},found:{ids['found']}>>").alias("taken"))

    def choose(state: Column, e: Column) -> Column:
        taken = F.array_append(state["taken"], F.struct(e["given"].alias("given"), e["found"].alias("found")))
        free = F.struct(
            e["given"].alias("last"),
            F.when(e["found"].isNull(), state["used"]).otherwise(F.array_append(state["used"], e["found"])).alias("used"),
            F.when(e["found"].isNull(), state["taken"]).otherwise(taken).alias("taken"))
        settled = state["last"].eqNullSafe(e["given"]) | F.coalesce(F.array_contains(state["used"], e["found"]), F.lit(False))
        return F.when(settled, state).otherwise(free)

    listed = pairs.filter("given IS NOT NULL").groupBy("img").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    chosen = listed.select("es", F.aggregate("es", start, choose)["taken"].alias("taken"))
    kept = F.filter("es", lambda e: F.exists(
        F.col("taken"), lambda t: (t["given"] == e["given"]) & (t["found"] == e["found"])))
    return chosen.select(F.explode(F.transform(kept, lambda e: e["row"])).alias("row")).select("row.*")


def _by_proposals(pairs: DataFrame) -> DataFrame:
    """``one_to_one`` for all images at once: every given region asks its best candidate, a found
    region keeps the earliest asker and drops its later candidates; repeat until none is refused.
    That fixpoint equals the sequential assignment.
    """
    left = cut(pairs)
    best = F.struct("same", "area", (-F.col("found")).alias("o"))
    while True:
        asks = left.groupBy("img", "given").agg(F.max(F.struct(best.alias("k"), F.col("found"))).alias("b"))
        asks = asks.select("img", "given", F.col("b.found").alias("found"))
        held = asks.groupBy("img", "found").agg(F.min("given").alias("holder"), F.count("*").alias("n"))
        refused = held.filter(F.col("n") > 1)
        if refused.isEmpty():
            return left.join(asks, ["img", "given", "found"], "left_semi")
        left = cut(
            left.join(held.select("img", "found", "holder"), ["img", "found"], "left")
            .filter(F.col("holder").isNull() | (F.col("given") <= F.col("holder")))
            .drop("holder")
        )


def assign_ids(regions: DataFrame, base: str, has_id: str = "region_id") -> DataFrame:
    """Regions without an id get base, base.1, base.2, ... in id order within the image."""
    kept = regions.filter(F.col(has_id).isNotNull())
    lacking = numbered(regions.filter(F.col(has_id).isNull()), ["img"], ["rid"], "_n")
    named = F.when(F.col("_n") == 1, F.col(base)).otherwise(
        F.concat(F.col(base), F.lit("."), (F.col("_n") - 1).cast("string"))
    )
    return kept.unionByName(lacking.withColumn(has_id, named).drop("_n"))


def clip_regions(regions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clip to the boundary (img, bw, bh) and drop what lies outside.

    Regions with a column ``subs`` first grow over their children; afterwards the children are cropped to them.
    """
    frame = rects.rect(F.lit(0), F.lit(0), F.col("bw"), F.col("bh"))
    if "subs" in regions.columns:
        grown = regions.join(bounds, "img").withColumn("_g", rects.enclose(F.col("r"), F.col("subs")))
        # Children are relative to their parent's corner, which moves with each step.
        clipped = grown.withColumn("_c", rects.intersect(F.col("_g"), frame)).filter(F.col("_c.w") > 0)
        moved = F.transform("subs", lambda s: s.withField("x", s["x"] + F.col("r.x") - F.col("_c.x")).withField(
            "y", s["y"] + F.col("r.y") - F.col("_c.y")))
        return clipped.withColumn("subs", rects.crop_subs(F.col("_c"), moved)).withColumn("r", F.col("_c")).select(*regions.columns)
    return (
        regions.join(bounds, "img")
        .withColumn("r", rects.intersect(F.col("r"), frame))
        .filter(F.col("r.w") > 0)
        .drop("bw", "bh")
    )


def central_order(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Rank per image: larger size class first, then nearer to the centre, then kind and id.

    A pairwise rule (size only when sizes differ much) is not transitive, so size enters as a
    class: the power of 4/3 of the diameter. Classes come first, ties go by distance.
    """
    c = rects.center(F.col("r"))
    far = F.sqrt(F.pow(c["x"] - width // 2, F.lit(2)) + F.pow(c["y"] - height // 2, F.lit(2)))
    size = F.floor(F.ln(rects.diameter(F.col("r")).cast("double")) / F.ln(F.lit(4 / 3)))
    ready = regions.withColumn("_s", -size).withColumn("_f", F.round(far, 6))
    return numbered(ready, ["img"], ["_s", "_f", "kind", "rid"], "rank").drop("_s", "_f")


def primary_region(ordered: DataFrame, kinds: tuple[str, ...] = ("f", "p")) -> DataFrame:
    """First region of a primary kind in the order given by ``rank``."""
    return (
        ordered.filter(F.col("kind").isin(*kinds))
        .groupBy("img")
        .agg(F.min_by("rid", "rank").alias("rid"))
    )


def prime_region(ordered: DataFrame, points: DataFrame, kinds: tuple[str, ...] = ("f", "p", "u")) -> DataFrame:
    """Regions of the face kinds that contain the image's point (img, px, py) move to the front."""
    at = F.col("kind").isin(*kinds) & rects.contains_point(F.col("r"), F.col("px"), F.col("py"))
    inside = F.coalesce(at, F.lit(False))
    moved = ordered.join(points, "img", "left").withColumn("_o", F.when(inside, 0).otherwise(1))
    return numbered(moved.drop("px", "py"), ["img"], ["_o", "rank"], "new_rank").drop("_o")


def cap_per_kind(regions: DataFrame, caps: dict[str, int], order: list[Column], parent: str = "img"
                 ) -> DataFrame:
    """Keep the first ``caps[kind]`` sub-regions of each kind per parent."""
    w = Window.partitionBy(parent, "kind").orderBy(*order)
    cap = F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])[F.col("kind")]
    # The constant bound lets Spark cut each task's rows before the shuffle.
    return (
        regions.withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= max(caps.values()))
        .filter(F.col("_n") <= F.coalesce(cap, F.lit(0)))
        .drop("_n")
    )


def keep_extremes(regions: DataFrame, kind: str, parent: str = "img") -> DataFrame:
    """Leftmost and rightmost region of a kind per parent."""
    of_kind = regions.filter(F.col("kind") == kind)
    ends = of_kind.groupBy(parent).agg(
        F.min(F.struct(F.col("r.x").alias("x"), F.col("rid"))).alias("lo"),
        F.max(F.struct(F.col("r.x").alias("x"), (-F.col("rid")).alias("rid"))).alias("hi"),
    )
    return ends.select(parent, F.col("lo.rid").alias("leftmost"), (-F.col("hi.rid")).alias("rightmost"))


def evict_conflicts(fresh: DataFrame, present: DataFrame, tol: float = rects.MATCH_TOLERANCE) -> DataFrame:
    """Present sub-regions that survive: those no new region of another kind overlaps."""
    hit = overlap_pairs(fresh, present, tol).filter(~F.col("same"))
    gone = hit.select("img", F.col("found").alias("rid")).distinct()
    return present.join(gone, ["img", "rid"], "left_anti")


def last_list(regions: DataFrame) -> DataFrame:
    """Repeated lists of one image: the regions of its last line stand."""
    last = regions.groupBy("img").agg(F.max("line").alias("line"))
    return regions.join(last, ["img", "line"], "left_semi")


def _slabs(regions: DataFrame, reach: Column) -> DataFrame:
    """Cut each image into parts too far apart to influence each other, along x and then y."""
    parts = regions.withColumn("_slab", F.lit("")).withColumn("_reach", reach)
    for axis, size in (("x", "w"), ("y", "h")):
        ready = parts.withColumn("_lo", F.col(f"r.{axis}") - F.col("_reach"))
        ready = ready.withColumn("_hi", F.col(f"r.{axis}") + F.col(f"r.{size}") + F.col("_reach"))
        swept = running(ready, ["img", "_slab"], ["_lo", "rid"], _n=("count", None), _end=("max", F.col("_hi")))
        # A row starts a part when everything before it ends left of it: compare the previous end.
        keys = ["img", "_slab"]
        prev = swept.select(*keys, (F.col("_n") + 1).alias("_n"), F.col("_end").alias("_prev"))
        opened = swept.join(prev, [*keys, "_n"], "left").withColumn(
            "_open", (F.col("_prev").isNull() | (F.col("_prev") < F.col("_lo"))).cast("int")
        ).drop("_prev", "_end")
        counted = running(opened, keys, ["_n"], _part=("sum", F.col("_open")))
        parts = counted.withColumn("_slab", F.concat_ws(".", "_slab", F.col("_part").cast("string"))).drop(
            "_n", "_open", "_part", "_lo", "_hi"
        )
    return parts.drop("_reach")


def merge_regions(regions: DataFrame, mode: str = "avg", tol: float = rects.MATCH_TOLERANCE,
                  min_dim: int = rects.MIN_DIMENSION, min_aspect: float = 0.5, meet: bool = False) -> DataFrame:
    """Merge overlapping regions of each image, added one by one in id order.

    Kind "s" is of any shape; an optional column ``ear`` marks profiles that show an ear and so win over faces. With
    ``meet``, regions come in lists (column ``line``) that are intersected: those of a list after the first stay out unless
    they merge with a region that is there.

    The outcome depends on that order, so the merging itself runs on one group per *independent
    part* of an image: parts whose regions, with the slack of the swallow test, cannot meet.
    Output: img, rid (of the last region merged in), kind, r, n (regions merged into it).
    """
    tall, wide = F.col("r.h"), F.col("r.w")
    fit = regions.filter(
        (F.greatest(tall, wide) >= min_dim) & ((F.col("kind") == "s") | (F.least(wide / tall, tall / wide) >= min_aspect))
    ).withColumn("_ear", F.coalesce(F.col("ear"), F.lit(False)) if "ear" in regions.columns else F.lit(False))
    if meet:
        opened = fit.groupBy("img").agg(F.min("line").alias("_line"))
        fit = fit.join(opened, "img").withColumn("_must", F.col("line") > F.col("_line")).drop("_line")
    else:
        fit = fit.withColumn("_must", F.lit(False))
    big = fit.groupBy("img").count().filter(F.col("count") > PART_ROWS).select("img")
    if big.isEmpty():
        parts = fit.withColumn("_slab", F.lit(""))
    else:
        extent = fit.join(big, "img").groupBy("img").agg(
            F.max(F.greatest("r.w", "r.h")).alias("_m"),
            (F.max(F.greatest(F.col("r.x") + wide, F.col("r.y") + tall)) - F.min(F.least("r.x", "r.y"))).alias("_e"),
        )
        slack = (rects.SWALLOW_STRETCH - 1) / 2
        widest = F.col("_e") if mode == "max" else F.col("_m")
        ready = fit.join(extent, "img").withColumn("_k", F.ceil(widest * slack / 2) + 1)
        cut_up = _slabs(ready.drop("_m", "_e"), F.col("_k")).drop("_k")
        parts = fit.join(big, "img", "left_anti").withColumn("_slab", F.lit("")).unionByName(cut_up)
    rows = (
        parts.select("img", "_slab", "rid", "kind", *[F.col(f"r.{k}").cast("int").alias(k) for k in "xywh"], "_ear", "_must")
        .repartition("img", "_slab")
        .sortWithinPartitions("img", "_slab", "rid")
    )

    def run(batches):
        yield from merged_batches(batches, mode, tol, min_dim, rects.SWALLOW_STRETCH)

    out = rows.mapInArrow(run, "img bigint, rid bigint, kind string, x int, y int, w int, h int, n int")
    return out.select("img", "rid", "kind", rects.rect(*[F.col(k) for k in "xywh"]).alias("r"), "n")


def merge_pairs_simple(regions: DataFrame, tol: float = 0.25) -> DataFrame:
    """Faces absorb at most one profile each; profiles left over become faces.

    A face takes the first profile it contains, that contains it, or that overlaps it enough; a
    contained profile just goes, the others widen the face.
    """
    faces = regions.filter(F.col("kind") == "f")
    profiles = regions.filter(F.col("kind") == "p")
    a, b = F.col("gr"), F.col("fr")
    pairs = touching(faces, profiles).filter(
        rects.contains(b, a) | rects.contains(a, b) | (rects.overlap_mean(a, b) > tol)
    )
    taken = one_to_one(pairs.withColumn("same", F.lit(True)).withColumn("area", F.lit(0)))
    grown = F.when(rects.contains(b, a), a).otherwise(rects.union(a, b))
    changed = taken.select("img", F.col("given").alias("rid"), grown.alias("_new"))
    gone = taken.select("img", F.col("found").alias("rid"))
    kept = faces.select("img", "rid", "r").join(changed, ["img", "rid"], "left").select(
        "img", "rid", F.coalesce("_new", "r").alias("r")
    )
    promoted = profiles.select("img", "rid", "r").join(gone, ["img", "rid"], "left_anti")
    return kept.unionByName(promoted)
