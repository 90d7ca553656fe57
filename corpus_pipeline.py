"""Corpus preparation: quality, near copies, benchmark leaks, personal data, tokens.

Each stage takes the documents that the one before it kept, as written to the shared
folder, and keeps their columns; the last gives the tokens of every document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.bpe import Vocabulary, encode
from quotelock.llm.hostrules import keep_good
from quotelock.llm.ordermin import one_per_class
from quotelock.llm.pii import redact_texts
from quotelock.llm.staging import staged
from quotelock.llm.tiling import without_leaks
from quotelock.plans.registry import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host does.

    NULL and empty texts fail; a NULL source is one host; repeated rows are judged alike.
    """
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near texts, that with the least id.

    Whole texts are compared, whatever their length; repeated rows are copies like others, and
    texts without a word stay, one for each id.
    """
    return one_per_class(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered.

    NULL and empty texts cover nothing and stay; repeated rows are judged alike.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with spans of personal data replaced by their kind.

    NULL stays NULL; repeated rows stay, and texts of any length are read whole.
    """
    clean = redact_texts(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.char_length("text").cast(kind))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and as text what these decode to.

    NULL counts as empty; repeated rows stay, texts of any length are encoded whole, and
    columns named ``ids`` and ``n_tokens`` are replaced.
    """
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = encode(docs, vocabulary, "text", "ids", "text")
    others = [name for name in docs.columns if name not in ("text", "ids", "n_tokens")]
    return encoded.select(*others, "text", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The verdicts of near copies and of tiling are not within reach of SQL; the tests compare
#: the whole pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
