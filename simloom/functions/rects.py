"""Rectangle arithmetic on STRUCT<x, y, w, h> columns; sub-rectangles use parent coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_TOLERANCE = 0.5
SWALLOW_STRETCH = 1.2
MIN_DIMENSION = 8


def rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def whole(x: Column) -> Column:
    """Round to the nearest integer, halves to even (the rounding of pixel coordinates)."""
    return F.rint(x).cast("int")


def trunc(x: Column) -> Column:
    return x.cast("int")


def area(r: Column) -> Column:
    return r["w"].cast("bigint") * r["h"]


def intersect(a: Column, b: Column) -> Column:
    """Common rectangle; all zeros when there is none."""
    x = F.greatest(a["x"], b["x"])
    y = F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    hit = (w > 0) & (h > 0)
    zero = F.lit(0)
    return rect(*[F.when(hit, v).otherwise(zero) for v in (x, y, w, h)])


def union(a: Column, b: Column) -> Column:
    x = F.least(a["x"], b["x"])
    y = F.least(a["y"], b["y"])
    return rect(
        x,
        y,
        F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x,
        F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y,
    )


def average(a: Column, b: Column) -> Column:
    return rect(*[whole((a[k] + b[k]) * F.lit(0.5)) for k in "xywh"])


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w.cast("bigint") * h).otherwise(F.lit(0).cast("bigint"))


def iou(a: Column, b: Column) -> Column:
    c = overlap_area(a, b)
    both = area(a) + area(b) - c
    return F.when(both > 0, c / both).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column, tol: float = MATCH_TOLERANCE) -> Column:
    return (overlap_area(a, b) > 0) & (1 - iou(a, b) < tol)


def contains(a: Column, b: Column) -> Column:
    """a lies inside b."""
    return (
        (a["x"] >= b["x"])
        & (a["y"] >= b["y"])
        & (a["x"] + a["w"] <= b["x"] + b["w"])
        & (a["y"] + a["h"] <= b["y"] + b["h"])
    )


def contains_point(r: Column, px: Column, py: Column) -> Column:
    return (px >= r["x"]) & (px < r["x"] + r["w"]) & (py >= r["y"]) & (py < r["y"] + r["h"])


def overlap_mean(a: Column, b: Column) -> Column:
    """Common area over the mean of the two areas."""
    return overlap_area(a, b) / ((area(a) + area(b)) / 2)


def stretch(r: Column, sx: float, sy: float = 0) -> Column:
    """Grow or shrink about the centre; sizes and offsets truncate to integers."""
    w = trunc(r["w"] * F.lit(float(sx)))
    h = trunc(r["h"] * F.lit(float(sy or sx)))
    return rect(trunc(r["x"] + (r["w"] - w) / 2.0), trunc(r["y"] + (r["h"] - h) / 2.0), w, h)


def scale(r: Column, s: float) -> Column:
    return rect(*[whole(r[k] * F.lit(float(s))) for k in "xywh"])


def shift(r: Column, dx, dy) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["w"], r["h"])


def shift_subs(subs: Column, dx, dy) -> Column:
    return F.transform(subs, lambda s: shift(s, dx, dy))


def affine(r: Column, m: list[list[float]]) -> Column:
    """Box enclosing the rectangle and its image under a 2x3 matrix, grown from the original."""
    (a, b, c), (d, e, f) = m
    xs = [r["x"], r["x"] + r["w"], r["x"] + r["w"], r["x"]]
    ys = [r["y"], r["y"], r["y"] + r["h"], r["y"] + r["h"]]
    px = [trunc(F.lit(a) * x + F.lit(b) * y + F.lit(c)) for x, y in zip(xs, ys)]
    py = [trunc(F.lit(d) * x + F.lit(e) * y + F.lit(f)) for x, y in zip(xs, ys)]
    left, top = F.least(r["x"], *px), F.least(r["y"], *py)
    right = F.greatest(r["x"] + r["w"], *px)
    bottom = F.greatest(r["y"] + r["h"], *py)
    return rect(left, top, right - left, bottom - top)


def center(r: Column) -> Column:
    return F.struct(
        whole(r["x"] + r["w"] * F.lit(0.5)).alias("x"), whole(r["y"] + r["h"] * F.lit(0.5)).alias("y")
    )


def rotate(r: Column, m: list[list[float]]) -> Column:
    """Move the centre by a 2x3 matrix and keep the size."""
    (a, b, c), (d, e, f) = m
    p = center(r)
    vx = F.lit(a) * p["x"] + F.lit(b) * p["y"] + F.lit(c)
    vy = F.lit(d) * p["x"] + F.lit(e) * p["y"] + F.lit(f)
    return rect(trunc(vx - F.floor(r["w"] / 2)), trunc(vy - F.floor(r["h"] / 2)), r["w"], r["h"])


def turn(r: Column, phase: Column | int, parent_w, parent_h) -> Column:
    """Quarter turns inside a target parent: 1 counter-clockwise, 2 upside down, 3 clockwise."""
    p = (F.lit(phase) if isinstance(phase, int) else phase) % 4
    right = parent_w - (r["x"] + r["w"])
    low = parent_h - (r["y"] + r["h"])
    x = F.when(p == 1, r["y"]).when(p == 2, right).when(
        p == 3, parent_w - (r["y"] + r["h"])
    ).otherwise(r["x"])
    y = F.when(p == 1, parent_h - (r["x"] + r["w"])).when(p == 2, low).when(
        p == 3, r["x"]
    ).otherwise(r["y"])
    odd = p.isin(1, 3)
    return rect(
        x, y, F.when(odd, r["h"]).otherwise(r["w"]), F.when(odd, r["w"]).otherwise(r["h"])
    )


def unturn(r: Column, phase: Column | int, source_w, source_h) -> Column:
    """Undo ``turn``; the parent size given is the one ``turn`` produced."""
    p = (F.lit(phase) if isinstance(phase, int) else phase) % 4
    odd = p.isin(1, 3)
    back = F.when(odd, 4 - p).otherwise(p)
    w = F.when(odd, source_h).otherwise(source_w)
    h = F.when(odd, source_w).otherwise(source_h)
    return turn(r, back, w, h)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _moved(s: Column, dx: Column, dy: Column) -> Column:
    return s.withField("x", s["x"] + dx).withField("y", s["y"] + dy)


def nested(r: Column, box: Column, depth: int, inner: Callable[[Column, Column], Column],
           move: Callable[[Column], tuple[Column, Column]] | None = None) -> Column:
    """Region STRUCT<x, y, w, h, subs, ...> with ``box`` as its rectangle and its children, if ``depth`` is not 0,
    replaced by ``inner(child, box)`` after a move by ``move(box)``. Other fields stay.

    Children are in coordinates of their parent's corner and have ``depth - 1`` levels of children
    themselves. A NULL list of children stays NULL.
    """
    def build(b: Column) -> Column:
        out = r
        for k in "xywh":
            out = out.withField(k, b[k])
        if not depth:
            return out
        subs = F.transform(r["subs"], lambda s: _moved(s, *move(b))) if move else r["subs"]
        return out.withField("subs", F.transform(subs, lambda s: inner(s, b)))

    return _let(box, build)


def _in_place(r: Column) -> Callable[[Column], tuple[Column, Column]]:
    """The move that keeps children where they are in the image when the corner of r goes to that of a box."""
    return lambda b: (r["x"] - b["x"], r["y"] - b["y"])


def stretch_all(r: Column, sx: float, sy: float = 0, depth: int = 1, recurse: bool = True) -> Column:
    """``stretch`` of a region; children stay where they are in the image and, with ``recurse``, are stretched too."""
    def inner(s: Column, _: Column) -> Column:
        return stretch_all(s, sx, sy, depth - 1) if recurse else s

    return nested(r, stretch(r, sx, sy), depth, inner, _in_place(r))


def scale_all(r: Column, s: float, depth: int = 1) -> Column:
    """``scale`` of a region and of its children, each in its parent's coordinates."""
    return nested(r, scale(r, s), depth, lambda c, _: scale_all(c, s, depth - 1))


def clip_all(r: Column, frame: Column, depth: int = 1) -> Column:
    """``intersect`` of a region with a frame; children stay in place and are cropped to it, those outside go."""
    def inner(c: Column, b: Column) -> Column:
        return clip_all(c, rect(F.lit(0), F.lit(0), b["w"], b["h"]), depth - 1)

    out = nested(r, intersect(r, frame), depth, inner, _in_place(r))
    if not depth:
        return out
    return _let(out, lambda o: o.withField("subs", F.filter(o["subs"], lambda c: c["w"] > 0)))


def affine_all(r: Column, m: list[list[float]], depth: int = 1) -> Column:
    """``affine`` of a region and of its children, which are mapped by their place in the image."""
    return _mapped(r, affine(r, m), depth, lambda c: affine_all(c, m, depth - 1))


def rotate_all(r: Column, m: list[list[float]], depth: int = 1) -> Column:
    """``rotate`` of a region and of its children, which are mapped by their place in the image."""
    return _mapped(r, rotate(r, m), depth, lambda c: rotate_all(c, m, depth - 1))


def _mapped(r: Column, box: Column, depth: int, one: Callable[[Column], Column]) -> Column:
    def inner(c: Column, b: Column) -> Column:
        return _let(one(c), lambda o: _moved(o, -b["x"], -b["y"]))

    return nested(r, box, depth, inner, lambda _: (r["x"], r["y"]))


def turn_all(r: Column, phase: Column | int, parent_w, parent_h, depth: int = 1) -> Column:
    """``turn`` of a region in its parent and of its children in the turned region."""
    return nested(r, turn(r, phase, parent_w, parent_h), depth, lambda c, b: turn_all(c, phase, b["w"], b["h"], depth - 1))


def unturn_all(r: Column, phase: Column | int, source_w, source_h, depth: int = 1) -> Column:
    """Undo ``turn_all``; the parent size given is the one that it produced."""
    p = (F.lit(phase) if isinstance(phase, int) else phase) % 4
    odd = p.isin(1, 3)
    w, h = F.when(odd, source_h).otherwise(source_w), F.when(odd, source_w).otherwise(source_h)
    return turn_all(r, F.when(odd, 4 - p).otherwise(p), w, h, depth)


def diameter(r: Column) -> Column:
    return F.greatest(r["w"], r["h"])


def aspect(r: Column) -> Column:
    return r["w"] / r["h"]


def aspect_unit(r: Column) -> Column:
    return F.least(r["w"] / r["h"], r["h"] / r["w"])


def inflate_clip(r: Column, pct: float, bound_w, bound_h) -> Column:
    """Grow by a fraction about the centre, then clip to (0, 0, bound_w, bound_h)."""
    dx = F.floor((whole(r["w"] * F.lit(1.0 + pct)) - r["w"]) / 2).cast("int")
    dy = F.floor((whole(r["h"] * F.lit(1.0 + pct)) - r["h"]) / 2).cast("int")
    grown = rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)
    return intersect(grown, rect(F.lit(0), F.lit(0), bound_w, bound_h))


def enclose(r: Column, subs: Column) -> Column:
    """Parent grown over its sub-rectangles (which are relative to it)."""
    spread = F.aggregate(
        subs,
        F.struct(
            F.lit(0).alias("x0"), F.lit(0).alias("y0"), r["w"].alias("x1"), r["h"].alias("y1")
        ),
        lambda a, s: F.struct(
            F.least(a["x0"], s["x"]).alias("x0"),
            F.least(a["y0"], s["y"]).alias("y0"),
            F.greatest(a["x1"], s["x"] + s["w"]).alias("x1"),
            F.greatest(a["y1"], s["y"] + s["h"]).alias("y1"),
        ),
    )
    return rect(
        r["x"] + spread["x0"],
        r["y"] + spread["y0"],
        spread["x1"] - spread["x0"],
        spread["y1"] - spread["y0"],
    )


def crop_subs(r: Column, subs: Column) -> Column:
    frame = rect(F.lit(0), F.lit(0), r["w"], r["h"])
    return F.filter(F.transform(subs, lambda s: intersect(s, frame)), lambda s: s["w"] > 0)


def count_kinds(subs: Column, *kinds: str) -> Column:
    return F.size(F.filter(subs, lambda s: s["kind"].isin(*kinds))).cast("bigint")


def has_kind(subs: Column, *kinds: str) -> Column:
    return F.exists(subs, lambda s: s["kind"].isin(*kinds))


def keep_kinds(regions: Column, kinds: tuple[str, ...] = ("f", "p", "i", "n", "m")) -> Column:
    """Evaluable regions and, inside them, evaluable sub-regions."""
    kept = F.filter(regions, lambda r: r["kind"].isin(*kinds))
    return F.transform(
        kept, lambda r: r.withField("subs", F.filter(r["subs"], lambda s: s["kind"].isin(*kinds)))
    )


def region_from_points(left: Column, right: Column, nose: Column, mouth: Column) -> Column:
    """Box and landmark boxes from two eye points, a nose and a mouth point (0,0 = absent).

    All sizes are fixed multiples of the distance between the first two points.
    """
    dx, dy = left["x"] - right["x"], left["y"] - right["y"]
    gap = F.sqrt((dx * dx + dy * dy).cast("double"))
    size, eye, nos, mth = gap * 2.5, gap * 0.6, gap * 0.7, gap * 0.55
    ox = whole((left["x"] + right["x"]) * 0.5) - trunc(size / 2)
    oy = whole((left["y"] + right["y"]) * 0.5) - trunc(size / 3)

    def box(kind, p, dx, dy, w, h):
        return F.struct(
            F.lit(kind).alias("kind"),
            (p["x"] - trunc(dx) - ox).alias("x"),
            (p["y"] - trunc(dy) - oy).alias("y"),
            trunc(w).alias("w"),
            trunc(h).alias("h"),
        )

    def present(p):
        return (p["x"] != 0) | (p["y"] != 0)

    eyes = [box("i", p, eye / 2, eye / 2, eye, eye) for p in (left, right)]
    n, m = box("n", nose, nos / 2, nos / 2, nos, nos), box("m", mouth, mth, mth / 2, mth * 2, mth * 1.1)
    # Without a lambda over the boxes all of it compiles, and what they have in common is computed once.
    subs = (
        F.when(present(nose) & present(mouth), F.array(*eyes, n, m)).when(present(nose), F.array(*eyes, n))
        .when(present(mouth), F.array(*eyes, m)).otherwise(F.array(*eyes))
    )
    return F.struct(
        ox.alias("x"),
        oy.alias("y"),
        trunc(size).alias("w"),
        trunc(size).alias("h"),
        subs.alias("subs"),
    )
