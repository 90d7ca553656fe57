"""Quality of ``documents``, as ``labels`` marks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.linequality import judge, learn
from quotelock.plans.registry import table

NAME = "op12_quality_classifier"
#: Scores from here on are predicted as good.
THRESHOLD = 0.3


def build(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    labels = table(spark, folder, "labels").select("doc_id", "quality").where(~held_out)
    return judge(documents, learn(documents, labels)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "n_lines",
        "n_bad_lines",
    )


SQL = None
