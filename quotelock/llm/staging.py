"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quotelock.plans.checkpoints import ensure_checkpoint_dir


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` once as a table in the shared folder and read it from there.

    What follows survives lost executors without recomputing ``rows``, Spark knows
    the table's size when it plans joins with it, and row numbers given before the
    write stay as they are.
    """
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
