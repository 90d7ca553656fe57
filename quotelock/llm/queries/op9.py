"""Quality rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotelock.llm.hostrules import host_verdicts, judge, text_counts
from quotelock.llm.staging import staged
from quotelock.plans.registry import table

NAME = "op9_quality_rules"


def build(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    counts = staged(text_counts(documents), "text-counts")
    return judge(counts, host_verdicts(counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
windows AS (
    SELECT doc_id, pos, array_to_string(words[pos : pos + 4], ' ') AS sequence
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs)
),
repeated AS (
    SELECT doc_id, pos FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, sequence) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS place FROM repeated)
    GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY doc_id
),
counts AS (
    SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
failed AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
),
hosts AS (
    SELECT source, count(*) AS n, count_if(base_failed) AS k FROM failed GROUP BY source
),
prior AS (
    SELECT m, CASE WHEN coalesce(v, 0) = 0 THEN 1e6
        ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS s
    FROM (SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM hosts)
),
verdicts AS (
    SELECT source, (k + m * s) / (n + s) > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR coalesce(host_failed, false)) AS kept
FROM failed LEFT JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""
