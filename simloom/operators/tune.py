"""Best thresholds, scales and weights, read off sweep tables instead of searched for."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.scalars import real_value, rounded
from simloom.operators import evaluate
from simloom.operators.similarity import CHAIN_CELLS, METRICS, TILE_CELLS, Metric, Reducer, metric_of, pair_reduce, slabs, unit_values


def running_prf(counts: DataFrame, order: str, given: int) -> DataFrame:
    """Cumulative match and found up to each value of ``order``, with precision, recall and F.

    ``counts`` is bounded (histogram bins or ranks), hence the plain ordered window.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        order,
        F.sum("same").over(w).alias("match"),
        F.sum(F.col("same") + F.col("other")).over(w).alias("found"),
        F.lit(given).cast("bigint").alias("given"),
    )
    return evaluate.with_prf(sums)


def best_row(sweep: DataFrame, value: str) -> DataFrame:
    """Row with the best F; the larger value wins a tie."""
    return sweep.agg(F.max(F.struct("f", F.col(value).alias("t"))).alias("b")).select("b.t", "b.f")


def tune_top_n(hits: DataFrame, items: DataFrame, limit: int = 40) -> DataFrame:
    counts = evaluate.rank_counts(hits.filter(F.col("rank") <= limit), items)
    sweep = running_prf(counts, "rank", evaluate.given_pairs(items))
    return best_row(sweep, "rank").select(F.col("t").cast("double").alias("t"), "f")


def tune_radius(items: DataFrame, digits: int = evaluate.RESOLUTION, **how) -> DataFrame:
    """Best radius in [0, 1): every distinct rounded distance is a candidate."""
    counts = evaluate.pair_counts(items, digits=digits, **how)
    sweep = running_prf(counts, "bin", evaluate.given_pairs(items)).filter(F.col("bin") < 10**digits)
    return best_row(sweep, "bin").select(rounded(F.col("t") / 10**digits).alias("t"), "f")


def tune_either(hits: DataFrame, items: DataFrame, **how) -> DataFrame:
    both = tune_top_n(hits, items).unionByName(tune_radius(items, **how))
    return best_row(both, "t")


def tune_scale(items: DataFrame, t: float, digits: int = evaluate.RESOLUTION, **how) -> DataFrame:
    """Scale s of unit(s d) with the best F at a fixed threshold: unit(s d) <= t iff d <= real(t)/s."""
    counts = evaluate.pair_counts(items, scale=None, digits=digits, **how)
    sweep = running_prf(counts, "bin", evaluate.given_pairs(items)).filter(F.col("bin") > 0)
    top = best_row(sweep, "bin")
    return top.select(rounded(F.lit(real_value(t)) * 10**digits / F.col("t")).alias("scale"), "f")


def weight_grid(parts: int, steps: tuple[float, ...]) -> list[tuple[float, ...]]:
    return list(itertools.product(steps, repeat=parts))


#: The kernel whose squares are known in single precision.
_EUCLIDEAN = METRICS["l2"].block
#: Bits of a single-precision square that a table of logarithms leaves out, and how far its entries may be off for a square that is known to
#: 2^-12 of itself: half a step of the table and that error, halved by the square root, and rounding.
TABLE_SHIFT, TABLE_ERROR = 11, 2.2e-4


@functools.lru_cache(maxsize=8)
def _log_table(level: int) -> np.ndarray:
    """Logarithm of the normalised distance by the leading bits of its square; none for squares under 2^``level``."""
    bits = np.arange((1 << (31 - TABLE_SHIFT)) + 1, dtype=np.uint32) << TABLE_SHIFT
    with np.errstate(all="ignore"):
        low, high = (b.view(np.float32).astype(float) for b in (bits, bits + np.uint32((1 << TABLE_SHIFT) - 1)))
        table = np.log(unit_values(np.sqrt((low + high) / 2), 1.0)).astype(np.float32)
    table[~((low >= 2.0**level) & np.isfinite(high))] = np.nan
    return table


class _Products(Reducer):
    """Pairs of different items, and those with a common tag, whose weighted product of distances is within a limit.

    Euclidean distances come from single-precision squares and a table of logarithms, whose errors are bounded. No logarithm is
    above zero, so a pair within the limit for the least weights is for all candidates; the others are weighed for each, and
    those that come too near to the limit, or whose squares are too small to be known, are computed in full.
    """

    def __init__(self, metric: Metric, slices: list[tuple[int, int]], grid: np.ndarray, limit: float):
        self.metric, self.slices, self.grid, self.limit = metric, slices, grid, limit
        self.match, self.found = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
        self.band = TABLE_ERROR * np.abs(grid).sum(axis=1) + 1e-6 * abs(limit) if np.isfinite(limit) else np.zeros(len(grid))

    def add(self, q, x, times):
        if self.metric.block is _EUCLIDEAN and np.isfinite(self.limit) and len(self.grid):
            self._screened(q, x, times)
        else:
            for part in slabs(q, x, CHAIN_CELLS // 4):
                hit = self._within(*self._logs(q, part))
                self._count(hit, (q.tag[:, None] == part.tag[None, :]).reshape(-1), times)
        if len(np.intersect1d(q.ids, x.ids)):
            for part in slabs(q, x, TILE_CELLS):
                r, c = np.nonzero(q.ids[:, None] == part.ids[None, :])
                for s in range(0, len(r), CHAIN_CELLS // 4):
                    a, b = r[s : s + CHAIN_CELLS // 4], c[s : s + CHAIN_CELLS // 4]
                    self._count(self._exact(q, part, a, b), q.tag[a] == part.tag[b], -times)
        return iter(())

    def _count(self, hit: np.ndarray, alike: np.ndarray, times: int) -> None:
        self.found += times * np.array([np.count_nonzero(h) for h in hit])
        self.match += times * np.array([np.count_nonzero(h & alike) for h in hit])

    def _logs(self, q, x) -> tuple[np.ndarray, np.ndarray | None]:
        """Logarithms of the normalised distances of all cells per slice; which cells have a distance of zero in any."""
        return self._logs_of(lambda a, b: self.metric.block(q.mat[:, a:b], x.mat[:, a:b]).reshape(-1), len(q.ids) * len(x.ids))

    def _logs_of(self, dist: Callable[[int, int], np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray | None]:
        logs, zero = np.empty((len(self.slices), cells)), None
        for row, (a, b) in zip(logs, self.slices):
            d = unit_values(dist(a, b), 1.0)
            if not d.all():
                zero = d == 0 if zero is None else zero | (d == 0)
                d[d == 0] = 1.0
            np.log(d, out=row)
        return logs, zero

    def _within(self, logs: np.ndarray, zero: np.ndarray | None) -> np.ndarray:
        """Which cells are within the limit, per candidate; a distance of zero in any slice is."""
        hit = self.grid @ logs <= self.limit
        return hit if zero is None else hit | zero

    def _exact(self, q, x, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """``_within`` for listed cells."""
        if self.metric.block is not _EUCLIDEAN:
            one = np.array([[self.metric.block(q.mat[i : i + 1, a:b], x.mat[j : j + 1, a:b])[0, 0] for i, j in zip(r, c)] for a, b in self.slices])
            at = iter(one.reshape(len(self.slices), len(r)))
            return self._within(*self._logs_of(lambda a, b: next(at), len(r)))

        def dist(a: int, b: int) -> np.ndarray:
            gap = q.mat[r, a:b] - x.mat[c, a:b]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        return self._within(*self._logs_of(dist, len(r)))

    def _screened(self, q, x, times: int) -> None:
        sides, tables = [], []
        for a, b in self.slices:
            qs, xs = q.mat[:, a:b], x.mat[:, a:b]
            qq, xx = np.einsum("ij,ij->i", qs, qs), np.einsum("ij,ij->i", xs, xs)
            # The error of a square follows from the sizes of both sides: those under 2^12 of it are not known well enough.
            most = 2.0**12 * (b - a + 8) * 2.0**-23 * (qq.max(initial=0.0) + xx.max(initial=0.0))
            level = math.ceil(math.log2(most)) if 1e-30 < most < 1e30 else 128
            tables.append(_log_table(max(level, -100)))
            with np.errstate(all="ignore"):
                sides.append((np.c_[-2.0 * qs, qq, np.ones(len(qq))].astype(np.float32), np.c_[xs, np.ones(len(xx)), xx].astype(np.float32).T))
        least, grid = self.grid.min(axis=0).astype(np.float32), self.grid.astype(np.float32)
        low, high = ((self.limit + sign * self.band)[:, None].astype(np.float32) for sign in (-1, 1))
        sure = low.min()
        step = max(1, CHAIN_CELLS // max(1, len(q.ids)))
        most = min(step, len(x.ids)) * len(q.ids)
        squared, cells, weighed = np.empty(most, np.float32), np.empty(most, np.int64), np.empty(most, np.float32)
        known = np.empty((len(self.slices), most), np.float32)
        for s in range(0, len(x.ids), step):
            part = x.rows(slice(s, s + step))
            n = len(q.ids) * len(part.ids)
            sq, at, least_sum = squared[:n], cells[:n], weighed[:n]
            logs = known[:, :n]
            with np.errstate(all="ignore"):
                for i, ((left, right), table) in enumerate(zip(sides, tables)):
                    np.matmul(left, right[:, s : s + step], out=sq.reshape(len(q.ids), -1))
                    np.right_shift(sq.view(np.uint32), TABLE_SHIFT, out=at, casting="unsafe")
                    np.take(table, at, out=logs[i], mode="clip")
                np.matmul(least, logs, out=least_sum)
                rest = np.flatnonzero(~(least_sum <= sure))
            alike = (q.tag[:, None] == part.tag[None, :]).reshape(-1)
            near = alike[rest]
            self.found += times * (n - len(rest))
            self.match += times * (np.count_nonzero(alike) - np.count_nonzero(near))
            if not len(rest):
                continue
            with np.errstate(all="ignore"):
                sums = grid @ logs[:, rest]
                hit = sums <= low
                unsure = np.flatnonzero(~(hit | (sums > high)).all(axis=0))
            if len(unsure):
                hit[:, unsure] = self._exact(q, part, *np.divmod(rest[unsure], len(part.ids)))
            self._count(hit, near, times)

    def rows(self):
        yield [np.arange(len(self.grid)), self.match, self.found]


def weight_counts(items: DataFrame, slices: list[tuple[int, int]], candidates: list[tuple[float, ...]],
                  t: float, scale: float, digits: int = evaluate.RESOLUTION, metric: str = "l2", **layout) -> DataFrame:
    """(candidate, match, found) of the weighted product of per-slice distances at threshold t."""
    m = metric_of(metric)
    grid = np.array(candidates, float).reshape(len(candidates), len(slices))
    # A rounded product is within the threshold where the sum of weighted logarithms is under this one.
    most = (math.floor(t * 10**digits + 1e-6) + 0.5) / 10**digits
    limit = math.log(real_value(most) / scale) if 0 < most < 1 else (math.inf if most >= 1 else -math.inf)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("candidate", "match", "found")])
    tagged = items.select("item_id", "vec", F.col("label").alias("tag"))
    out = pair_reduce(tagged.withColumnRenamed("item_id", "query_id"), tagged, lambda: _Products(m, slices, grid, limit), schema, m, shared=True, **layout)
    return out.groupBy("candidate").agg(F.sum("match").alias("match"), F.sum("found").alias("found"))


def tune_weights(items: DataFrame, slices: list[tuple[int, int]], t: float, scale: float,
                 steps: tuple[float, ...] = (0.3, 0.9), rounds: int = 1,
                 objective: Callable[[DataFrame], DataFrame] | None = None, **layout) -> DataFrame:
    """Weights in [0, 1] with the best F: all pairs are scored for a whole grid per pass, and each
    further round halves the grid around the best candidate."""
    given = evaluate.given_pairs(items)
    candidates = weight_grid(len(slices), steps)
    half = (max(steps) - min(steps)) / 2
    for left in range(rounds, 0, -1):
        counts = weight_counts(items, slices, candidates, t, scale, **layout)
        sweep = evaluate.with_prf(counts.withColumn("given", F.lit(given).cast("bigint")))
        if objective is not None:
            sweep = objective(sweep)
        if left > 1:
            top = candidates[best_row(sweep, "candidate").first()["t"]]
            half /= 2
            near = [sorted({max(0.0, w - half), w, min(1.0, w + half)}) for w in top]
            candidates = list(itertools.product(*near))
    table = items.sparkSession.createDataFrame(
        [(i, list(map(float, c))) for i, c in enumerate(candidates)], "candidate bigint, weights array<double>"
    )
    return sweep.join(F.broadcast(table), "candidate")
