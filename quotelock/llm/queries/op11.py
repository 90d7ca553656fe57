"""Hard negatives of every fiftieth vector of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.llm.negatives import hard_negatives
from quotelock.plans.registry import table

NAME = "op11_hard_negatives"


def build(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), lambda key: key % 50 == 0)


SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors AS a JOIN vectors AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, other_id AS negative_id,
    positive_score, score AS negative_score
FROM positives AS p JOIN scored AS s ON p.anchor_id = s.anchor_id AND NOT alike
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW nearest AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER nearest <= 3
"""
