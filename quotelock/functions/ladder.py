"""Ordered, fail-closed rule ladders.

A ladder is a list of ``(holds, code)`` pairs in contract order. The first rule
that does not hold gives the row its code; a rule that evaluates to NULL counts
as not holding, so missing data can never pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, "str | Column"]


def holds(condition: Column) -> Column:
    """``condition`` with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def first_failure(rules: Sequence[Rule], passed: Column | None = None) -> Column:
    """Code of the first rule that fails, else ``passed`` (NULL by default)."""
    chain: Column | None = None
    for condition, code in rules:
        outcome = code if isinstance(code, Column) else F.lit(code)
        failed = ~holds(condition)
        chain = F.when(failed, outcome) if chain is None else chain.when(failed, outcome)
    if chain is None:
        raise ValueError("a ladder needs at least one rule")
    return chain.otherwise(F.lit(None).cast("string") if passed is None else passed)


def at_most(value: Column, limit: int | None) -> Column:
    """``value <= limit``, or only that there is a value; false for NULL."""
    return value.isNotNull() if limit is None else holds(value <= limit)


def whole_number(value: Column, low: int, high: int | None) -> Column:
    """``low <= value <= high``, false for NULL."""
    return holds(value >= low) & at_most(value, high)


def bounded_chars(value: Column, limit: int, empty: bool = False) -> Column:
    """Length rule counted in code points."""
    size = F.char_length(value)
    return holds((size <= limit) if empty else size.between(1, limit))


def bounded_bytes(value: Column, limit: int | None, empty: bool = False) -> Column:
    """Length rule counted in UTF-8 bytes."""
    return whole_number(F.octet_length(value), 0 if empty else 1, limit)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Column expressions are trees, so a helper that uses its argument several times
    repeats it; binding keeps long derivations linear in size.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
