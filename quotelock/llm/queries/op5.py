"""Personal data over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.pii import BASE, detect
from quotelock.plans.registry import table

NAME = "op5_pii"


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ","
    )


def counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda span: span["kind"] == kind))


def build(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda span: span["kind"].isin(*BASE))
    counts = [counted(kind).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return detect(documents).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


#: Offsets and Luhn sums of matches are not within reach of DuckDB's patterns; the tests
#: compare the query with the plain patterns instead.
SQL = None
