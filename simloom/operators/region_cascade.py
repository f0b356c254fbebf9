"""Matching of regions and of the children of matched regions, image by image, on rows that are sorted by image.

A batch holds whole images; the pairs of all its images are worked out at once. The results are those of ``regions.one_to_one`` on
``regions.overlap_pairs``: given regions choose in id order, and rows of one id count together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, position) of every member of runs that begin at ``starts``."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[run]


def _cross(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal keys; both are sorted."""
    low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    return _spread(low, high - low)


class _Boxes:
    """Regions as arrays: a key within which they meet, id, kind as a number (-1 without one) and edges."""

    def __init__(self, key, rid, named, kind, edges, fit):
        self.key, self.rid, self.named, self.kind, self.edges, self.fit = key, rid, named, kind, edges, fit

    def rows(self, at: np.ndarray, key: np.ndarray | None = None) -> _Boxes:
        return _Boxes(self.key[at] if key is None else key, self.rid[at], self.named[at], self.kind[at], self.edges[:, at], self.fit[at])


def _met(g: _Boxes, f: _Boxes, tol: float, min_dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(given, found, same) of the chosen pairs of rows; both sides are sorted by key."""
    a, b = _cross(g.key, f.key)
    some = g.fit[a] & f.fit[b] & g.named[a]
    a, b = a[some], b[some]
    gx, gy, gw, gh = g.edges[:, a]
    fx, fy, fw, fh = f.edges[:, b]
    wide, tall = np.minimum(gx + gw, fx + fw) - np.maximum(gx, fx), np.minimum(gy + gh, fy + fh) - np.maximum(gy, fy)
    area = wide * tall
    near = (wide > 0) & (tall > 0) & (area >= min_dim * min_dim)
    near[near] = 1 - area[near] / (gw * gh + fw * fh - area)[near] < tol
    a, b, area = a[near], b[near], area[near]
    known = (g.kind[a] >= 0) & (f.kind[b] >= 0)
    order = np.where(known, (g.kind[a] != f.kind[b]).astype(np.int64), 2)
    by = np.lexsort((f.rid[b], ~f.named[b], -area, order, g.rid[a], g.key[a]))
    a, b, order = a[by], b[by], order[by]
    key, given, found, named = g.key[a], g.rid[a], f.rid[b], f.named[b]
    new = np.r_[True, (key[1:] != key[:-1]) | (given[1:] != given[:-1])] if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    # The regions of a key choose in turn; one that chooses a region without an id is out.
    choice, chosen = np.zeros(len(starts), found.dtype), np.zeros(len(starts), bool)
    ends, keys, ids, ok = np.r_[starts[1:], len(a)].tolist(), key[starts].tolist(), found.tolist(), named.tolist()
    last, used = None, set()
    for i, (s, e) in enumerate(zip(starts.tolist(), ends)):
        if keys[i] != last:
            last, used = keys[i], set()
        for j in range(s, e):
            if not ok[j]:
                break
            if ids[j] not in used:
                used.add(ids[j])
                choice[i], chosen[i] = ids[j], True
                break
    group = np.cumsum(new) - 1
    keep = named & chosen[group] & (found == choice[group])
    return a[keep], b[keep], order[keep] == 0


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


def _kinds(col: pa.Array, known: dict[str, int]) -> np.ndarray:
    coded = col.dictionary_encode()
    names = np.array([known.setdefault(k, len(known)) for k in coded.dictionary.to_pylist()] + [-1])
    return names[pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False)]


def _boxes(part, key: np.ndarray, known: dict[str, int]) -> _Boxes:
    rid, named = _numbers(part("rid"))
    sides = [_numbers(part(c)) for c in "xywh"]
    edges, fit = np.stack([s for s, _ in sides]), np.logical_and.reduce([ok for _, ok in sides])
    return _Boxes(key, rid, named, _kinds(part("kind"), known), edges, fit & (edges[2] > 0) & (edges[3] > 0))


def cascade_totals(batches: Iterable[pa.RecordBatch], sub_weight: float, tol: float, min_dim: int, sub_kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """One row (top, low, more): what pairs and pairs of children earn, and how often children count beyond once.

    Rows (img, side, rid, kind, x, y, w, h, subs) sorted by img; side 0 is given and 1 is found.
    """
    top = low = 0.0
    more, known, rest = 0, {}, None

    def add(table: pa.Table) -> None:
        nonlocal top, low, more
        rows = table.combine_chunks().to_batches()[0]
        img = rows.column("img").dictionary_encode().indices.to_numpy().astype(np.int64)
        side = rows.column("side").to_numpy()
        every = _boxes(rows.column, img, known)
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        at = [where[np.argsort(img[where], kind="stable")] for where in at]
        a, b, same = _met(every.rows(at[0]), every.rows(at[1]), tol, min_dim)
        if not len(a):
            return
        a, b = at[0][a], at[1][b]
        top += float(np.where(same, 1.0, sub_weight).sum())
        # Rows of one id of a side of an image are one group.
        by = np.lexsort((every.rid, every.named, side, img))
        new = np.r_[True, np.any([c[by][1:] != c[by][:-1] for c in (every.rid, every.named, side, img)], axis=0)]
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(by)])
        subs = rows.column("subs")
        inside = pc.list_value_length(subs)
        inside = pc.fill_null(inside, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = subs.flatten()
        children = _boxes(lambda c: pc.struct_field(flat, c), np.zeros(len(flat), np.int64), known)
        counts = np.isin(children.kind, [known[k] for k in sub_kinds if k in known])
        begin = np.cumsum(inside) - inside

        def of(groups: np.ndarray, keys: np.ndarray) -> tuple[_Boxes, np.ndarray]:
            """Children of all rows of each group, with the key of the group; which group each is of."""
            run, row = _spread(first[groups], size[groups])
            row = by[row]
            parent, child = _spread(begin[row], inside[row])
            run = run[parent]
            run, child = run[counts[child]], child[counts[child]]
            order = np.argsort(keys[run], kind="stable")
            return children.rows(child[order], keys[run][order]), run[order]

        asking = np.unique(group[a])
        g, _ = of(asking, asking)
        f, owner = of(group[b], group[a])
        _, _, same = _met(g, f, tol**0.5, min_dim)
        low += float(np.where(same, 1.0, sub_weight).sum())
        # A region of several pairs counts its children once for each.
        own = np.bincount(owner, minlength=len(b))
        _, at_first, times = np.unique(group[b], return_index=True, return_counts=True)
        more += int((own[at_first] * (times - 1)).sum())

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        last = table.column("img")[table.num_rows - 1]
        whole = int(pc.index(table.column("img"), last).as_py())
        rest = table.slice(whole)
        if whole:
            add(table.slice(0, whole))
    if rest is not None and rest.num_rows:
        add(rest)
    yield pa.RecordBatch.from_pydict({"top": pa.array([top], pa.float64()), "low": pa.array([low], pa.float64()), "more": pa.array([more], pa.int64())})
