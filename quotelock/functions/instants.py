"""Instants kept as text and compared to the nanosecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelock.functions.ladder import holds

_DATE = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_CLOCK = r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
_ZONE = r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"
INSTANT_PATTERN = rf"^{_DATE}{_CLOCK}(\.\d{{1,9}})?{_ZONE}$"
DATE_PATTERN = rf"^{_DATE}$"
CANONICAL_PATTERN = rf"^{_DATE}{_CLOCK}\.\d{{3}}Z$"


def _number(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start, size).try_cast("bigint")


def instant_key(value: Column, allow_date_only: bool = False) -> Column:
    """``struct<seconds, nanos>`` that orders instants; NULL when not an instant.

    Spark timestamps stop at microseconds and roll second 60 over, so the text is
    checked by pattern and the day by a calendar cast.
    """
    day = F.unix_date(F.substring(value, 1, 10).try_cast("date")).cast("bigint")
    utc = F.endswith(value, F.lit("Z"))
    zone = F.when(utc, 1).otherwise(6)
    sign = F.when(F.substring(value, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(utc, F.lit(0).cast("bigint")).otherwise(
        sign * (_number(value, -5, 2) * 3600 + _number(value, -2, 2) * 60)
    )
    seconds = (
        day * 86400
        + _number(value, 12, 2) * 3600
        + _number(value, 15, 2) * 60
        + _number(value, 18, 2)
        - offset
    )
    fraction = F.substring(value, F.lit(21), F.greatest(F.lit(0), F.char_length(value) - 20 - zone))
    nanos = F.rpad(fraction, 9, "0").try_cast("bigint")
    full = F.when(
        holds(value.rlike(INSTANT_PATTERN)) & day.isNotNull(),
        F.struct(seconds.alias("seconds"), nanos.alias("nanos")),
    )
    if not allow_date_only:
        return full
    midnight = F.struct((day * 86400).alias("seconds"), F.lit(0).cast("bigint").alias("nanos"))
    return F.when(holds(value.rlike(DATE_PATTERN)) & day.isNotNull(), midnight).otherwise(full)


def instant_ns(value: Column, allow_date_only: bool = False) -> Column:
    """Nanoseconds since the epoch as ``DECIMAL(29,0)``; NULL when not an instant."""
    key = instant_key(value, allow_date_only)
    scaled = key["seconds"].cast("decimal(18,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return (scaled + key["nanos"].cast("decimal(18,0)")).cast("decimal(29,0)")


def is_instant(value: Column) -> Column:
    """A valid instant of at most 64 characters."""
    return holds((F.char_length(value) <= 64) & instant_key(value).isNotNull())


def is_canonical_instant(value: Column) -> Column:
    """True when formatting the parsed instant gives the same text back."""
    return holds(value.rlike(CANONICAL_PATTERN) & instant_key(value).isNotNull())


def in_order(*values: Column) -> Column:
    """Each instant is no earlier than the one before it; false if any is invalid."""
    keys = [instant_key(value) for value in values]
    result = F.lit(True)
    for earlier, later in zip(keys, keys[1:]):
        result = result & holds(earlier <= later)
    return result


def midnight_if_date(value: Column) -> Column:
    """A date-only text becomes that day's midnight in UTC; others are unchanged."""
    return F.when(F.contains(value, F.lit("T")), value).otherwise(
        F.concat(value, F.lit("T00:00:00.000Z"))
    )
