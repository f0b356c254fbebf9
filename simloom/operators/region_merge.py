"""Rules for adding one rectangle to a list of merged ones (runs inside a task, per image part)."""

from __future__ import annotations

from itertools import chain, groupby

import pyarrow as pa


def _common(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0


def _inside(a, b, stretch):
    """a lies inside b stretched about its centre."""
    w, h = int(b[2] * stretch), int(b[3] * stretch)
    x, y = int(b[0] + (b[2] - w) / 2), int(b[1] + (b[3] - h) / 2)
    return x <= a[0] and y <= a[1] and a[0] + a[2] <= x + w and a[1] + a[3] <= y + h


def _combined(a, b, mode):
    if mode == "avg":
        return tuple(round((p + q) * 0.5) for p, q in zip(a, b))
    if mode == "min":
        x, y = max(a[0], b[0]), max(a[1], b[1])
        w = min(a[0] + a[2], b[0] + b[2]) - x
        h = min(a[1] + a[3], b[1] + b[3]) - y
        return (x, y, w, h) if w > 0 and h > 0 else (0, 0, 0, 0)
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)


def _clash(ok, old_ear, nk, new_ear):
    """Of two kinds, a face beats a profile unless the profile shows an ear."""
    if ok == "p":
        return "keep_old" if old_ear else "keep_new"
    if nk == "p":
        return "keep_new" if new_ear else "keep_old"
    return "keep_new"


def _dominant(a, a_ear, b, b_ear):
    """Kind of two regions that become one: an ear-bearing profile, then a face, then the present one."""
    if a == b or b not in "fp":
        return a
    if a not in "fp":
        return b
    if a == "p" and a_ear or b == "p" and b_ear:
        return "p"
    return "f" if "f" in (a, b) else a


def _verdict(old, new, tol, min_area, stretch):
    """What a present region and an incoming one do to each other.

    One of: both (stay), combine, keep_old, keep_new. A kind "s" (area map) merges by containment
    with its own kind only.
    """
    (ok, o, old_ear), (nk, n, new_ear) = old, new
    same = ok == nk
    if not same and "s" in (ok, nk):
        return "both"
    common = _common(o, n)
    size_o, size_n = o[2] * o[3], n[2] * n[3]
    close = common > min_area and 1 - common / (size_o + size_n - common) < tol
    clash = "combine" if same else _clash(ok, old_ear, nk, new_ear)
    if close and not (same and ok == "s"):
        return clash
    if _inside(n, o, stretch) or _inside(o, n, stretch):
        return "combine"
    if same and ok != "s":
        if common > tol * size_n:
            return "keep_old"
        if common > tol * size_o:
            return "keep_new"
    elif not same and (common > tol * size_o or common > tol * size_n):
        return clash
    return "both"


def merge_rows(rows, mode, tol, min_dim, stretch):
    """Merge (rid, kind, rect, ear, must_meet) rows in the given order into (rid, kind, rect, n) rows.

    ``ear`` and ``must_meet`` may be left out. A row that must meet stays out unless a present region gave way to it.
    """
    kept: list[tuple] = []
    for rid, kind, box, *more in rows:
        ear, must = (*more, False, False)[:2]
        count, after, lost = 1, [], False
        for i, old in enumerate(kept):
            act = _verdict((old[1], old[2], old[4]), (kind, box, ear), tol, min_dim * min_dim, stretch)
            if act == "both":
                after.append(old)
            elif act == "combine":
                box = _combined(old[2], box, "max" if kind == "s" else mode)
                kind, ear = _dominant(old[1], old[4], kind, ear), ear or old[4]
                count += old[3]
            elif act == "keep_old":
                # Whatever it absorbed before it was refused is gone with it.
                after += kept[i:]
                lost = True
                break
        alone = must and len(after) == len(kept)
        kept = after if lost or alone else [*after, (rid, kind, box, count, ear)]
    return [row[:4] for row in kept]


def merged_batches(batches, mode, tol, min_dim, stretch):
    """Rows sorted by (img, part, rid) -> merged rows, one part in memory at a time."""
    names = ("img", "rid", "kind", "x", "y", "w", "h", "n")
    types = (pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 5)

    def pack(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names)
        )

    rows = chain.from_iterable(zip(*b.to_pydict().values()) for b in batches)
    held: list[tuple] = []
    for (img, _), part in groupby(rows, key=lambda r: r[:2]):
        boxes = ((r[2], r[3], r[4:8], r[8], r[9]) for r in part)
        for rid, kind, box, n in merge_rows(boxes, mode, tol, min_dim, stretch):
            held.append((img, rid, kind, *box, n))
        if len(held) >= 10_000:
            yield pack(held)
            held = []
    if held:
        yield pack(held)
