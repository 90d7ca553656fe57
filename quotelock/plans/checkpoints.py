"""Cutting lineage through shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where none is.

    On a cluster the folder is shared and named by ``spark.checkpoint.dir``. The
    fallback is for single-machine runs such as tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quotelock-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the checkpoint folder once and read them from there."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)
