"""All registered queries of the package; importing this module registers them."""

from __future__ import annotations

from simloom.llm import queries_curation, queries_native, queries_text  # noqa: F401
from simloom.llm.registry import QUERIES, SQL  # noqa: F401
