"""Ordered computations over groups of any size.

A window partitioned by group alone sorts each whole group in one task. Here the
order is cut into blocks: rows meet only the rows of their block, one small row
per block carries the state between blocks, and the two are joined. A group that
holds a third of the table is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
BLOCK_SECONDS = 30 * 86400


def join_with_nulls(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` in which NULL meets NULL, so no row is lost or left without a partner."""
    renamed = other.withColumnsRenamed({name: f"_other_{name}" for name in keys})
    condition = F.lit(True)
    for name in keys:
        condition = condition & rows[name].eqNullSafe(renamed[f"_other_{name}"])
    return rows.join(renamed, condition, how).drop(*[f"_other_{name}" for name in keys])


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    tiebreak: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the cumulative sum of ``value`` per group, ordered by an integer column.

    Rows with NULL order come first and count towards all that follow.
    """
    staged = rows.withColumns({"_block": F.floor(F.col(order) / block_rows), "_value": value})
    totals = staged.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order, *tiebreak)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_with_nulls(staged.withColumn("_inside", F.sum("_value").over(inside)), carried, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.coalesce(F.col("_inside"), F.lit(0)))
        .drop("_block", "_value", "_inside", "_before")
    )


def carry_forward(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    out: str,
    strict: bool = False,
) -> DataFrame:
    """Add the last non-NULL ``value`` at (or, when ``strict``, before) each row.

    ``block`` must not decrease along ``order``, for example a month number.
    """
    staged = rows.withColumns({"_block": block, "_value": value})
    ordering = F.struct(*order)
    totals = (
        staged.where(F.col("_value").isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by("_value", ordering).alias("_last"))
    )
    blocks = join_with_nulls(staged.select(*keys, "_block").distinct(), totals, [*keys, "_block"])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    return (
        join_with_nulls(
            staged.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)), carried, [*keys, "_block"]
        )
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_block", "_value", "_inside", "_before")
    )


def with_previous(
    rows: DataFrame, keys: Sequence[str], sequence: str, columns: dict[str, Column]
) -> DataFrame:
    """Add, as struct ``previous``, the given columns of the row with sequence - 1.

    Sequences are explicit, so the neighbour is found by an equi join on
    ``(keys, sequence)``; no window over the whole group is needed. Where several rows
    have that place there is no neighbour: ``previous`` is NULL, and no row is doubled.
    """
    ahead = (
        rows.groupBy(*keys, (F.col(sequence) + 1).alias(sequence))
        .agg(
            F.count("*").alias("_places"),
            F.first(F.struct(*[column.alias(name) for name, column in columns.items()])).alias("previous"),
        )
        .where("_places = 1")
        .drop("_places")
    )
    return rows.join(ahead, [*keys, sequence], "left")


def copies_of_place(rows: DataFrame, keys: Sequence[str], sequence: str, out: str) -> DataFrame:
    """Add the number of rows at each row's ``(keys, sequence)``."""
    counted = rows.groupBy(*keys, sequence).agg(F.count("*").alias(out))
    return join_with_nulls(rows, counted, [*keys, sequence])
