"""Benchmark leaks in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotelock.llm.tiling import leaks
from quotelock.plans.registry import table

NAME = "op7_decontamination"


def build(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


SQL = None
