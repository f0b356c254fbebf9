"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = (
    "sources",
    "predicates",
    "scalar",
    "joins",
    "aggregates",
    "ranking",
    "maintenance",
    "neardups",
    "regions",
    "nested",
    "evaluation",
    "routing",
    "likelihood",
    "streams",
    "extensions",
)


def load():
    from simloom.plans import catalogue

    for family in FAMILIES:
        importlib.import_module(f"simloom.plans.{family}")
    return catalogue
