"""The queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from quotelock.plans.registry import Build

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")


def _load() -> list:
    return [import_module(f"quotelock.llm.queries.{module}") for module in MODULES]


def queries() -> dict[str, Build]:
    return {module.NAME: module.build for module in _load()}


def oracle_sql() -> dict[str, str]:
    return {module.NAME: module.SQL for module in _load() if module.SQL is not None}
