"""Files in, write-once sinks out, and checkpoint settings."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quotelock.plans.checkpoints import cut_lineage, ensure_checkpoint_dir
from quotelock.sources.sinks import exclusive_sink
from quotelock.sources.snapshots import capture_snapshots, read_files


def test_files_become_snapshots(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    files = read_files(spark, str(tmp_path), "*.txt")
    rows = capture_snapshots(files, F.lit("2026-01-01"), F.lit("2026-01-02T00:00:00.000Z"))
    found = {row.source_uri[-5:]: row for row in rows.collect()}
    assert found["a.txt"].failure_code is None and found["a.txt"].snapshot.byte_length == 6
    assert found["a.txt"].snapshot.available_at == "2026-01-01T00:00:00.000Z"
    assert found["b.txt"].failure_code == "SOURCE_NOT_UTF8" and found["b.txt"].snapshot is None


def test_sinks_never_overwrite(spark, tmp_path):
    rows = spark.range(3)
    exclusive_sink(rows, f"{tmp_path}/out")
    with pytest.raises(AnalysisException):
        exclusive_sink(spark.range(5), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_lineage_is_cut_in_the_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    rows = cut_lineage(spark.range(5).repartition(2))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 5
