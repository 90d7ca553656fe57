"""Licence statements in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.licenses import scan
from quotelock.plans.registry import table

NAME = "op8_license_scan"


def build(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentences", ",").alias("sentences"),
        "n_unknown",
    )


SQL = None
