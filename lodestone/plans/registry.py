"""All registered queries of the engine itself and their DuckDB counterparts."""

from __future__ import annotations

from lodestone.plans import code, corpus, graph, prompts, ranks, search
from lodestone.plans.shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "corpus", "graph", "prompts", "ranks", "search"]
