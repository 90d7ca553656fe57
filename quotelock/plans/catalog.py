"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from quotelock.plans.registry import QUERIES, Query

MODULES = ("citations", "scalars", "chains", "audits", "review", "trust", "streams")


def load() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"quotelock.plans.{module}")
    return dict(QUERIES)
