"""Byte-pair encoding and decoding over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.bpe import Vocabulary, encode
from quotelock.plans.registry import table

NAME = "op3_bpe"
VOCABULARY = "byte_bpe_50k.json"


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the text decoded from them."""
    vocabulary = Vocabulary.load(path or public_tokenizers.path(VOCABULARY))
    return encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def build(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(table(spark, folder, "documents"))


SQL = None
