"""Near copies among ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotelock.llm.ordermin import near_copies
from quotelock.plans.registry import table

NAME = "op10_near_dedup"


def build(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents")).select("doc_id", "class_id")


SQL = None
