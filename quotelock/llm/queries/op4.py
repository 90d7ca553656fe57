"""Repeated word sequences in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.substrings import remove_repeats
from quotelock.plans.registry import table

NAME = "op4_substring_dedup"


def build(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, pos, hash(words[pos : pos + 12]) AS sequence, words[pos : pos + 12] AS list
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs)
),
repeated AS (
    SELECT doc_id, pos FROM windows
    QUALIFY min(doc_id) OVER (PARTITION BY sequence, list) < doc_id
),
gone AS (
    SELECT doc_id, list(DISTINCT place) AS places
    FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS place FROM repeated)
    GROUP BY doc_id
),
placed AS (
    SELECT docs.doc_id, len(words) AS n_words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place
    FROM docs
),
kept AS (
    SELECT placed.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY placed.place) AS text
    FROM placed LEFT JOIN (SELECT doc_id, unnest(places) AS place FROM gone) AS lost
        ON placed.doc_id = lost.doc_id AND placed.place = lost.place
    WHERE lost.place IS NULL
    GROUP BY placed.doc_id
)
SELECT docs.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""
