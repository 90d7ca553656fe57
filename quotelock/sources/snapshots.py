"""Source snapshots: capture, content dedupe and the content-addressed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions.instants import instant_key, is_canonical_instant, midnight_if_date
from quotelock.functions.ladder import at_most, first_failure, holds
from quotelock.functions.records import object_path, snapshot_reference


TEXT_MEDIA_TYPE = "text/plain; charset=utf-8"

SNAPSHOT_FIELDS = (
    "media_type",
    "sha256",
    "byte_length",
    "object_path",
    "source_uri",
    "captured_at",
    "available_at",
)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path`` as ``(source_uri, content)`` rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("source_uri"), "content")


def capture_snapshots(
    sources: DataFrame,
    available_at: Column,
    captured_at: Column,
    media_type: Column | str = TEXT_MEDIA_TYPE,
    max_bytes: int | None = None,
) -> DataFrame:
    """Turn ``(source_uri, content, …)`` rows into snapshot records.

    Every row is kept. Rows that may not be captured carry a ``failure_code`` and
    a NULL ``snapshot``; the digest of an oversized content is never computed.
    """
    media = F.lit(media_type) if isinstance(media_type, str) else media_type
    staged = sources.withColumns(
        {
            "available_at": available_at,
            "captured_at": captured_at,
            "byte_length": F.octet_length("content").cast("bigint"),
        }
    ).withColumns(
        {
            "_available": instant_key(F.col("available_at"), allow_date_only=True),
            "_captured": instant_key(F.col("captured_at")),
        }
    )
    code = first_failure(
        [
            (F.col("_available").isNotNull(), "INVALID_TIMESTAMP"),
            (is_canonical_instant(F.col("captured_at")), "INVALID_TIMESTAMP"),
            (F.col("_available") <= F.col("_captured"), "TIMESTAMP_ORDER_INVALID"),
            (F.col("content").isNotNull(), "SNAPSHOT_MISSING"),
            (at_most(F.col("byte_length"), max_bytes), "SNAPSHOT_TOO_LARGE"),
            (F.is_valid_utf8("content"), "SOURCE_NOT_UTF8"),
        ]
    )
    staged = staged.withColumn("failure_code", code).withColumn(
        "sha256", F.when(F.col("failure_code").isNull(), F.sha2("content", 256))
    )
    snapshot = F.struct(
        media.alias("media_type"),
        F.col("sha256"),
        F.col("byte_length"),
        object_path(F.col("sha256")).alias("object_path"),
        F.col("source_uri"),
        F.col("captured_at"),
        midnight_if_date(F.col("available_at")).alias("available_at"),
    )
    return (
        staged.withColumn("snapshot", F.when(F.col("failure_code").isNull(), snapshot))
        .withColumn(
            "snapshot_ref",
            F.when(F.col("failure_code").isNull(), snapshot_reference(F.col("snapshot"))),
        )
        .drop("_available", "_captured", "sha256", "byte_length", "available_at", "captured_at")
    )


def content_dedupe(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per distinct content: ``(sha256, snapshot_ref, copies, outcome)``.

    ``incoming`` has ``(snapshot_ref, sha256)``; ``stored`` has ``(sha256,
    stored_sha256)`` where ``stored_sha256`` is the digest of the bytes found under
    that key. A key that is stored without a readable digest is a mismatch, never written
    over, and content without a digest cannot be stored. Contents stay out of the shuffle,
    and copies are counted before it.
    """
    distinct = incoming.groupBy("sha256").agg(
        F.min("snapshot_ref").alias("snapshot_ref"), F.count("*").alias("copies")
    )
    if stored is None:
        return distinct.withColumn("outcome", F.when(F.col("sha256").isNull(), "SNAPSHOT_HASH_MISMATCH").otherwise("store"))
    found = stored.groupBy("sha256").agg(
        F.bool_and(F.coalesce(F.col("stored_sha256") == F.col("sha256"), F.lit(False))).alias("_intact")
    )
    return distinct.join(found, "sha256", "left").select(
        "sha256",
        "snapshot_ref",
        "copies",
        F.when(F.col("sha256").isNotNull() & F.col("_intact").isNull(), "store")
        .when(F.col("_intact"), "present")
        .otherwise("SNAPSHOT_HASH_MISMATCH")
        .alias("outcome"),
    )


def write_object_store(contents: DataFrame, path: str) -> None:
    """Write ``(sha256, content)`` once, partitioned by the first two hex digits."""
    (
        contents.withColumn("shard", F.substring("sha256", 1, 2))
        .write.partitionBy("shard")
        .mode("errorifexists")
        .parquet(path)
    )


def read_object_store(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """Read the store; naming ``shards`` prunes partitions."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.where(F.col("shard").isin(shards))


def write_snapshot_table(snapshots: DataFrame, table: str, buckets: int) -> None:
    """Save snapshots bucketed by reference, so that gates never shuffle contents."""
    (
        snapshots.write.bucketBy(buckets, "snapshot_ref")
        .sortBy("snapshot_ref")
        .mode("errorifexists")
        .saveAsTable(table)
    )


def snapshots_by_hash(snapshots: DataFrame, sha256: str | None = None, limit: int | None = None) -> DataFrame:
    """References of a content digest by capture time, or of each digest when None.

    The per-digest form keeps the ``limit`` earliest rows of every digest, or all.
    """
    key = F.struct(instant_key(F.col("captured_at")), F.col("snapshot_ref"))
    if sha256 is not None:
        found = snapshots.where(F.col("sha256") == sha256).orderBy(key)
        return found if limit is None else found.limit(limit)
    from quotelock.operators.review import first_per_key

    return first_per_key(snapshots, "sha256", key, limit, rank="position")


def snapshot_facts(snapshots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """What the stored bytes really are: size, digest and text, once per snapshot."""
    length = F.octet_length("content").cast("bigint")
    return snapshots.select(
        "snapshot_ref",
        length.alias("actual_length"),
        F.when(at_most(length, max_bytes), F.sha2("content", 256)).alias("actual_sha256"),
        F.when(holds(F.is_valid_utf8("content")), F.col("content").cast("string")).alias("text"),
    )
