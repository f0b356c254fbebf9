"""Small learners that are fitted on bounded tables: a decision tree and a logistic model with lasso weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """``share`` of ones among the rows that get here; rows with column <= cut go to ``low``."""

    share: float
    column: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, least: int = 1, cuts: int = 64,
             columns: np.ndarray | None = None) -> Node:
    """Greedy Gini splits on up to ``cuts`` quantiles of each column."""
    share = float(y.mean()) if len(y) else 0.5
    if not depth or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (0.0, -1, 0.0)
    now = len(y) * share * (1 - share)
    for c in range(x.shape[1]) if columns is None else columns:
        values = np.unique(x[:, c])
        if len(values) > cuts:
            values = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 1)))
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= cut
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            gain = now - n * a * (1 - a) - (len(y) - n) * b * (1 - b)
            if gain > best[0] + 1e-9:
                best = (gain, int(c), float(cut))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], fit_tree(x[low], y[low], depth - 1, least, cuts, columns),
                fit_tree(x[~low], y[~low], depth - 1, least, cuts, columns))


def predict_tree(node: Node, row) -> float:
    while node.low is not None:
        node = node.low if row[node.column] <= node.cut else node.high
    return node.share


#: A rule is a conjunction of (column, is_high, cut): value > cut if is_high, else value <= cut.
Rule = tuple[tuple[int, bool, float], ...]


def paths(node: Node, so_far: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to every node but the root."""
    out = [so_far] if so_far else []
    if node.low is not None:
        out += paths(node.low, (*so_far, (node.column, False, node.cut)))
        out += paths(node.high, (*so_far, (node.column, True, node.cut)))
    return out


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for column, high, cut in rule:
        out &= (x[:, column] > cut) == high
    return out


class Ones:
    """A matrix of zeros and ones, kept as the columns of the ones in each row; for fit_lasso, which multiplies by vectors only."""

    def __init__(self, hits, columns: int):
        self.shape = len(hits), columns
        self.at = np.fromiter((j for h in hits for j in h), np.int64)
        self.row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])

    def astype(self, kind) -> Ones:
        return self

    @property
    def T(self) -> Ones:
        out = object.__new__(Ones)
        out.shape, out.at, out.row = self.shape[::-1], self.row, self.at
        return out

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.at], self.shape[0])


def fit_lasso(x: np.ndarray | Ones, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic model with an L1 penalty, by accelerated proximal gradient descent."""
    n = max(len(y), 1)
    start = float(np.clip(y.mean() if len(y) else 0.5, 0.5 / n, 1 - 0.5 / n))
    bias, w = np.log(start / (1 - start)), np.zeros(x.shape[1])
    if not len(y) or not x.shape[1] or y.min() == y.max():
        return float(bias), w
    x = x.astype(np.float32)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        probe = x.T @ (x @ probe)
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    rate = 4 * n / (norm + n)
    last_b, last_w, t = bias, w, 1.0
    for _ in range(steps):
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zw = bias + (t - 1) / nt * (bias - last_b), w + (t - 1) / nt * (w - last_w)
        off = 1 / (1 + np.exp(-np.clip(x @ zw.astype(np.float32) + zb, -40, 40))) - y
        gw = x.T @ off.astype(np.float32) / n
        last_b, last_w, t = bias, w, nt
        bias = zb - rate * off.mean()
        moved = zw - rate * gw
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate * strength, 0)
    return float(bias), w
