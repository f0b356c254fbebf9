"""Extension points: metrics, fusions, variants, predicates, objectives and likelihood models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from simloom.operators import fusion, similarity


@dataclass
class Registry:
    """Names to callables; a name is taken once unless it is replaced on purpose."""

    kind: str
    entries: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str, value: Any, replace: bool = False) -> None:
        if name in self.entries and not replace:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.entries[name] = value

    def get(self, name: str) -> Any:
        try:
            return self.entries[name]
        except KeyError:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {sorted(self.entries)}") from None


METRICS = Registry("metric", similarity.METRICS)
FUSIONS = Registry("fusion", fusion.FUSIONS)
VARIANTS = Registry("variant")
PREDICATES = Registry("predicate")
OBJECTIVES = Registry("objective")
MODELS = Registry("model")


def register_metric(name: str, expr: Callable[[Column, Column], Column],
                    block: Callable[..., Any], triangle: bool = False, replace: bool = False) -> None:
    """A distance as a column expression and as a NumPy kernel over two matrices, which searches use.

    ``triangle`` says that the triangle inequality holds, which lets joins skip far cells.
    """
    if not callable(block):
        raise ValueError(f"metric {name!r} needs a block kernel: searches compare blocks of rows")
    METRICS.add(name, similarity.Metric(name, expr, block, triangle), replace)


def register_fusion(name: str, combine: Callable[..., DataFrame], replace: bool = False) -> None:
    FUSIONS.add(name, combine, replace)


def register_variant(spark, name: str, udtf: Any, replace: bool = False) -> None:
    """A Python UDTF (id, vec) -> (variant, vec); it can be called in SQL under its name."""
    VARIANTS.add(name, udtf, replace)
    spark.udtf.register(name, udtf)


def register_predicate(name: str, test: Callable[[Column], Column], replace: bool = False) -> None:
    """A test of one region, usable in filters over tables and over arrays."""
    PREDICATES.add(name, test, replace)


def register_objective(name: str, score: Callable[[DataFrame], DataFrame], replace: bool = False) -> None:
    """Rewrites the ``f`` column of a sweep: what tuning maximises."""
    OBJECTIVES.add(name, score, replace)


def register_model(name: str, score: Callable[[DataFrame], Column], replace: bool = False) -> None:
    """A likelihood model: rows in, score column out."""
    MODELS.add(name, score, replace)
