"""The engine's queries: importing this module registers them all."""

from __future__ import annotations

from nearfold import registry
from nearfold.plans import extract_queries, graph_queries, kernel_queries, record_queries, search_queries, source_queries  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
