"""Streaming queries, run to the end of the given tables and compared with batch SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotelock.plans.checkpoints import ensure_checkpoint_dir
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    DECIDED_SQL,
    ENTRIES_SQL,
    candidates,
    packets,
    snapshots,
)
from quotelock.streaming import appends

c = F.col


class _Streamed:
    """A session whose ``read`` is ``readStream`` with the schema of the same file."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    @property
    def read(self) -> "_Streamed":
        return self

    def parquet(self, path: str) -> DataFrame:
        schema = self._spark.read.parquet(path).schema
        # A glob, because a table may be one file or a folder of files.
        pattern = path.removesuffix("t") + "[t]"
        return self._spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(pattern)


def _run_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""WITH {DECIDED_SQL}
    SELECT candidate_id, CASE WHEN failure_code IS NULL THEN 'verified' ELSE 'rejected' END AS outcome, failure_code
    FROM decided"""
)
def stream_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates arrive as a stream, snapshots are a table, outcomes are appended."""
    target = _run_folder(spark, "promotion")
    gated = appends.stream_promotion(
        candidates(_Streamed(spark), folder), snapshots(spark, folder).select("snapshot_ref", "content")
    ).select("candidate_id", "outcome", "failure_code")
    writer = gated.writeStream.format("parquet").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start(f"{target}/rows").awaitTermination()
    return spark.read.schema("candidate_id string, outcome string, failure_code string").parquet(f"{target}/rows")


def _arriving(
    rows: DataFrame, target: str, parts: Sequence[Column], start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """``rows`` arrive part by part; after each, a stream over all that came runs to its end.

    The stream is stopped and started again on its checkpoint, so every part is one batch
    or more of its own, and state must outlive the query.
    """
    spark = rows.sparkSession
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{target}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{target}/in")).awaitTermination()


@query("SELECT sha256(text) AS sha256, min('doc:' || doc_id) AS snapshot_ref FROM documents GROUP BY 1")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Content arrives in three parts, in order of its reference."""
    target = _run_folder(spark, "dedupe")
    incoming = table(spark, folder, "documents").select(
        F.concat(F.lit("doc:"), c("doc_id").cast("string")).alias("snapshot_ref"),
        F.sha2("text", 256).alias("sha256"),
    )
    first = F.coalesce(F.substring("snapshot_ref", 5, 1), F.lit(""))
    _arriving(
        incoming, target, [first <= "3", (first > "3") & (first <= "6"), first > "6"],
        lambda rows: appends.stream_dedupe(rows, f"{target}/rows", f"{target}/state"),
    )
    return spark.read.parquet(f"{target}/rows").select("sha256", "snapshot_ref")


@query(
    f"""WITH RECURSIVE {ENTRIES_SQL}, arrived AS (
      SELECT collection_id, sequence, previous_entry_sha256, entry_sha256,
        CASE WHEN collection_id % 4 = 1 AND sequence > 2 THEN 'PACKET_APPEND_GAP' END AS failure_code
      FROM entries WHERE NOT (collection_id % 4 = 1 AND sequence = 2)
      UNION ALL
      SELECT CASE WHEN collection_id % 3 > 0 THEN collection_id END, sequence, NULL, NULL,
        CASE WHEN collection_id % 3 > 0 THEN 'PACKET_APPEND_STALE' ELSE 'PACKET_INDEX_INVALID' END
      FROM packets WHERE sequence = 1 AND collection_id % 5 = 0)
    SELECT collection_id, sequence,
      CASE WHEN failure_code IS NULL THEN previous_entry_sha256 END AS previous_entry_sha256,
      CASE WHEN failure_code IS NULL THEN entry_sha256 END AS entry_sha256, failure_code
    FROM arrived"""
)
def stream_chain_append(spark: SparkSession, folder: str) -> DataFrame:
    """Packets appended to chains in three parts.

    Every fourth chain lost its second packet; of every fifth the first comes once more at
    the end, and without its chain in every third of these.
    """
    target = _run_folder(spark, "chains")
    rows = packets(spark, folder).where(~((F.pmod("collection_id", F.lit(4)) == 1) & (c("sequence") == 2)))
    late = packets(spark, folder).where((F.pmod("collection_id", F.lit(5)) == 0) & (c("sequence") == 1))
    lost = late.withColumn("collection_id", F.when(F.pmod("collection_id", F.lit(3)) > 0, c("collection_id")))
    arriving = rows.withColumn("late", F.lit(False)).unionByName(lost.withColumn("late", F.lit(True)))
    _arriving(
        arriving, target, [~c("late") & (c("sequence") == 1), ~c("late") & (c("sequence") > 1), c("late")],
        lambda rows: appends.stream_chain_append(rows, f"{target}/rows", f"{target}/state"),
    )
    return spark.read.parquet(f"{target}/rows").select(
        "collection_id", "sequence", "previous_entry_sha256", "entry_sha256", "failure_code"
    )
