"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on resampled labelled documents, the paths to their nodes are conjunctive rules, a logistic model with lasso
weights keeps few of them, and those become one Spark column expression over the statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import row_hash, staged, with_columns
from simloom.llm.hashing import word_hashes
from simloom.llm.learners import Rule, fires, fit_lasso, fit_tree, paths

#: Labelled documents to fit on, at most; trees, their depth, and the lasso strength.
FIT_ROWS, TREES, DEPTH, STRENGTH = 20_000, 24, 3, 0.002
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
STATISTICS = ("n_words", "word_length", "distinct_share", "repeat_share", "upper_share", "digit_share", "symbol_share", "pipe_share",
              "shout_share", "stop_share", "line_words", "same_line_share", "beyond_ascii_share")


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns in a struct ``row`` and one DOUBLE per name of STATISTICS, over whole texts; NULL is empty."""

    def run(batches):
        # A few texts at a time: a batch of very long ones would need much memory.
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, max(whole.num_rows, 1), 256)):
            hashes, n = word_hashes(b.column(1))
            ends = np.cumsum(n)
            again = np.concatenate(([0], np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) else []))
            rows = []
            for t, k, e in zip(b.column(1).cast(pa.binary()).to_pylist(), n.tolist(), ends.tolist()):
                t = t or b""
                lines = t.split(b"\n")
                letters = _without(t, _LOWER + _UPPER)
                own = hashes[e - k:e]
                rows.append((
                    float(k), _share(len(t), k), _share(len(np.unique(own)), k), _share(again[e - 1] - again[e - k], k) if k > 1 else 0.0,
                    _share(_without(t, _UPPER), letters), _share(_without(t, _DIGITS), len(t)), _share(_without(t, b"#$%&*^~@<>{}[]\\"), len(t)),
                    _share(t.count(b"|"), k), _share(t.count(b"!"), k), _share(_without(t, b".,;:?"), k), _share(k, len(lines)),
                    1 - len(set(lines)) / len(lines), _share(len(t) - len(t.decode()), len(t))))
            cols = [pa.array(c, pa.float64()) for c in zip(*rows)] or [pa.array([], pa.float64())] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *STATISTICS])

    picked = docs.select(F.struct(F.lit(0).alias("_none"), *carry).alias("row"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, with_columns(picked.schema["row"].dataType, **dict.fromkeys(STATISTICS, "double")))


def bounded_sample(labels: DataFrame, limit: int) -> DataFrame:
    """The rows of ``labels``, or about ``limit`` of them picked by their hash if there are more."""
    total = labels.count()
    if total <= limit:
        return labels
    h = row_hash(labels)["a"]
    return labels.filter(F.pmod(h, F.lit(1_000_000)) < F.lit(int(1_000_000 * limit / total)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, strength: float = STRENGTH,
        seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """(bias, rules with their weights) from statistics and 0/1 labels."""
    pick = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(trees if len(y) else 0):
        rows = pick.integers(0, len(y), min(len(y), 4000))
        columns = pick.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        for rule in paths(fit_tree(x[rows], y[rows], depth, least=max(2, len(rows) // 200), cuts=24, columns=columns)):
            rules[rule] = None
    found = list(rules)
    hit = np.stack([fires(r, x) for r in found], 1) if found else np.zeros((len(y), 0))
    bias, weights = fit_lasso(hit, y, strength)
    return bias, [(r, float(w)) for r, w in zip(found, weights) if abs(w) > 1e-6]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The model as a column over STATISTICS."""
    total = F.lit(bias)
    for rule, weight in rules:
        holds = F.lit(True)
        for column, high, cut in rule:
            value = F.col(STATISTICS[column])
            holds = holds & ((value > cut) if high else (value <= cut))
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
          fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, score): the chance of label 1 for every row of ``docs``.

    ``learn`` is a condition on the rows of ``labels`` to fit on, at most about ``fit_rows`` of them, joined by key. Rows of
    ``labels`` with NULL label or key are left out; several labels of one key count one by one. Without labelled rows,
    or with labels of one kind, the score is the smoothed share of ones. NULL and empty texts have all statistics at 0 and
    are scored like others. An empty table gives no rows.
    """
    named = staged(statistics(docs, text, (key,)).withColumn("_key", F.col(f"row.{key}")), "statistics")
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"))
    sample = named.join(F.broadcast(bounded_sample(known, fit_rows)), "_key").select("_key", "_y", *STATISTICS).toPandas()
    sample = sample.sort_values(["_key", "_y", *STATISTICS])
    bias, rules = fit(sample[list(STATISTICS)].to_numpy(float), sample["_y"].to_numpy(float))
    return named.select(F.col("_key").alias(key), compiled(bias, rules).alias("score"))
