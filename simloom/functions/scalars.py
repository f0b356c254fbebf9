"""Normalisers and the threshold grammar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
"""Distances are compared on this many decimals, so ties break by id on every layout."""

DEFAULT_RADIUS = 0.5
DEFAULT_TOP_N = 1024


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """Round and fold -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def unit(d: Column) -> Column:
    """[0, inf) -> [0, 1)."""
    return F.lit(2 / math.pi) * F.atan(F.lit(math.pi / 2) * d)


def real(d: Column) -> Column:
    """Inverse of ``unit``."""
    return F.lit(2 / math.pi) * F.tan(F.lit(math.pi / 2) * d)


def unit01(d: Column) -> Column:
    """(-inf, inf) -> (0, 1)."""
    return F.lit(0.5) + F.atan(d) / F.lit(math.pi)


def real_value(d: float) -> float:
    """``real`` on the driver, for a threshold given as a number."""
    return 2 / math.pi * math.tan(math.pi / 2 * d)


def threshold_top_n(t: Column) -> Column:
    """Whole part of a threshold >= 1; NULL when the threshold sets no count."""
    return F.when(t >= 1, F.floor(t).cast("bigint"))


def threshold_max_dist(t: Column) -> Column:
    """Distance part of a threshold: T itself in [0, 1), the fraction above 1, NULL when absent."""
    frac = t - F.floor(t)
    return F.when((t >= 0) & (t < 1), t).when((t >= 1) & (frac > 0), frac)


def split_threshold(t: float) -> tuple[int | None, float | None]:
    """The same grammar for a number: (top_n, max_dist); (None, None) keeps everything."""
    if t < 0:
        return None, None
    if t < 1:
        return None, float(t)
    n = int(t)
    return n, (t - n) or None


def penalise(d: Column, flag: Column) -> Column:
    return F.when(flag, F.sqrt(d)).otherwise(d)


def result_limit(t: Column, max_results: Column) -> Column:
    """Row limit of a service request: its own maximum joins T; at or under 1 means no limit."""
    total = t + F.coalesce(max_results, F.lit(0))
    return F.when(total >= 1, F.floor(total).cast("bigint"))
