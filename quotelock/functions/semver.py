"""Semantic versions as comparable structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelock.functions.ladder import holds

_CORE = r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
_IDENTIFIER = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER_PATTERN = rf"^{_CORE}(?:-({_IDENTIFIER}(?:\.{_IDENTIFIER})*))?$"


def is_semver(value: Column, allow_prerelease: bool = True, max_length: int = 128) -> Column:
    pattern = SEMVER_PATTERN if allow_prerelease else rf"^{_CORE}$"
    return holds(value.rlike(pattern) & (F.char_length(value) <= max_length))


def semver_parts(value: Column) -> list[Column]:
    """Major, minor, patch and prerelease text of a valid version."""
    return [F.regexp_extract(value, SEMVER_PATTERN, group) for group in (1, 2, 3, 4)]


def _digits(text: Column) -> Column:
    # Without leading zeros, (length, digits) orders like the number, of any size.
    return F.struct(F.char_length(text).alias("width"), text.alias("digits"))


def semver_key(value: Column, allow_prerelease: bool = True) -> Column:
    """Comparable struct in version precedence order; NULL when not a version."""
    major, minor, patch, prerelease = semver_parts(value)
    identifiers = F.transform(
        F.split(prerelease, r"\."),
        lambda part: F.struct(
            F.when(part.rlike(r"^\d+$"), 0).otherwise(1).alias("textual"),
            F.when(part.rlike(r"^\d+$"), F.char_length(part)).otherwise(0).alias("width"),
            part.alias("text"),
        ),
    )
    return F.when(
        is_semver(value, allow_prerelease),
        F.struct(
            _digits(major).alias("major"),
            _digits(minor).alias("minor"),
            _digits(patch).alias("patch"),
            (prerelease == "").cast("int").alias("released"),
            identifiers.alias("identifiers"),
        ),
    )


def semver_bump(previous: Column, current: Column) -> Column:
    """Which core part differs first: major, minor, else patch."""
    before, after = semver_parts(previous), semver_parts(current)
    return F.when(
        is_semver(previous) & is_semver(current),
        F.when(before[0] != after[0], "major").when(before[1] != after[1], "minor").otherwise("patch"),
    )


def bump_rank(bump: Column) -> Column:
    return F.when(bump == "major", 3).when(bump == "minor", 2).when(bump == "patch", 1)
