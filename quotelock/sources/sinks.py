"""Write-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "json", "orc", "csv", "text")


def exclusive_sink(rows: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write ``rows`` to a new ``path``; an existing one is an error, never replaced."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    rows.write.mode("errorifexists").options(**options).format(fmt).save(path)
