"""Languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.langid import identify, learn
from quotelock.plans.registry import table

NAME = "op2_language_id"


def build(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    field = learn(documents.where(~held_out), "doc_id")
    return identify(documents, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_switches")


SQL = None
