"""Check queries over the given tables."""

from __future__ import annotations

import importlib

from chartspark.harness.registry import QUERIES, Query

MODULES = ("expressions", "merging", "measuring", "reading", "coding", "reviewing", "exchange")


def load_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"chartspark.harness.{module}")
    return QUERIES
