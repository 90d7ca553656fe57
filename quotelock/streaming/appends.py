"""Continuous capture: promotion, content dedupe and chain appends as streams.

Late data is rejected with a code, never reordered. Deduplication and chains keep
exact state by key (:mod:`quotelock.streaming.keyed`), because an identity never expires.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quotelock.functions.digests import canonical_split
from quotelock.functions.ladder import first_failure
from quotelock.operators.chains import LINK_MEMBER, chain_build
from quotelock.operators.gate import promotion_gate
from quotelock.operators.lineage import packet_payload
from quotelock.streaming.keyed import ChainAppender, FirstSeen, use_state_store


def stream_promotion(candidates: DataFrame, snapshots: DataFrame, **options: object) -> DataFrame:
    """Gate a stream of candidates against a static snapshot table.

    A stream-static join and the batch ladder, in append mode without state.
    """
    return promotion_gate(candidates, snapshots, **options)


def _start(rows: DataFrame, store_path: str, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(store_path)


def _least_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = pa.Table.from_batches([batch]).group_by("sha256").aggregate([("snapshot_ref", "min")])
        yield from least.select(["sha256", "snapshot_ref_min"]).rename_columns(["sha256", "snapshot_ref"]).to_batches()


def stream_dedupe(
    incoming: DataFrame, store_path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Store each content digest of a stream of ``(snapshot_ref, sha256)`` once.

    A digest is stored with the least reference of the batch that brought it first. There
    is no watermark: content seen at any time before is not stored again. Copies inside a
    slice of the input are combined before the shuffle, so content that very many rows
    share is few rows there. A NULL digest is content that cannot be told apart, and counts
    as one.
    """
    use_state_store(incoming.sparkSession)
    schema = "sha256 string, snapshot_ref string"
    combined = incoming.select("sha256", "snapshot_ref").mapInArrow(_least_of_batches, schema)
    stored = combined.groupBy("sha256").transformWithState(FirstSeen("sha256", "snapshot_ref"), schema, "Append", "None")
    return _start(stored, store_path, checkpoint, once)


ENTRY_SCHEMA = (
    "collection_id bigint, sequence bigint, packet_sha256 string, source_sha256 string, "
    "source_byte_length bigint, candidate_id string, evidence_id string, "
    "previous_entry_sha256 string, entry_sha256 string, failure_code string"
)


IDENTITIES = ("packet_sha256", "candidate_id", "evidence_id")
COLUMNS = ("sequence", "packet_sha256", "source_sha256", "source_byte_length", "candidate_id", "evidence_id")


def append_batch(
    batch: DataFrame,
    stored: DataFrame,
    chain: Sequence[str] = ("collection_id",),
    max_entries: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Append one batch of packets to the chains kept so far.

    ``batch`` names the sequence each packet claims. Per chain the batch is accepted from
    the stored head as far as it continues without a fault; every later row, and every
    stale, duplicate or overflowing one, keeps its place with a code. Rows without a chain
    are rejected: there is no head that they could continue.
    """
    from quotelock.plans.blocks import join_with_nulls, running_sum

    chain = list(chain)
    kept = stored.where(F.col("failure_code").isNull())
    heads = kept.groupBy(*chain).agg(
        F.max_by("entry_sha256", "sequence").alias("head_sha256"),
        F.max("sequence").alias("_head"),
        F.sum("source_byte_length").alias("_bytes"),
    )
    claims = batch.groupBy(*chain, "sequence").agg(F.count("*").alias("_claims"))
    staged, fresh = batch, F.lit(True)
    for name in IDENTITIES:
        first = batch.groupBy(*chain, name).agg(F.min("sequence").alias(f"_first_{name}"))
        seen = kept.select(*chain, name).distinct().withColumn(f"_seen_{name}", F.lit(True))
        staged = join_with_nulls(staged, first, [*chain, name]).join(seen, [*chain, name], "left")
        fresh = fresh & F.col(name).isNotNull() & F.col(f"_seen_{name}").isNull()
        fresh = fresh & (F.col("sequence") == F.col(f"_first_{name}"))
    staged = (
        join_with_nulls(staged, claims, [*chain, "sequence"])
        .join(heads.select(*chain, "_head", "_bytes"), chain, "left")
        .withColumns({"_head": F.coalesce("_head", F.lit(0)), "_bytes": F.coalesce("_bytes", F.lit(0))})
    )
    new_bytes = F.when(F.col("sequence") > F.col("_head"), F.col("source_byte_length"))
    staged = running_sum(staged, chain, "sequence", new_bytes, "_total", ["packet_sha256"])
    named = F.lit(True)
    for name in chain:
        named = named & F.col(name).isNotNull()
    own = first_failure(
        [
            (named, "PACKET_INDEX_INVALID"),
            (F.col("sequence") > F.col("_head"), "PACKET_APPEND_STALE"),
            (F.col("_claims") == 1, "PACKET_APPEND_FORK"),
            (fresh, "PACKET_INDEX_DUPLICATE"),
            (F.lit(True) if max_entries is None else F.col("sequence") <= max_entries, "PACKET_INDEX_FULL"),
            (
                F.lit(True) if max_bytes is None else F.col("_bytes") + F.col("_total") <= max_bytes,
                "PACKET_COLLECTION_BYTES_EXCEEDED",
            ),
        ]
    )
    staged = staged.withColumn("failure_code", own)
    # The longest run from the head: rows up to the first sequence that is not valid
    # or not there.
    good = staged.where(F.col("failure_code").isNull()).select(*chain, "sequence", "_head")
    following = good.select(*chain, (F.col("sequence") + 1).alias("sequence"), F.lit(True).alias("_after"))
    breaks = (
        good.join(following, [*chain, "sequence"], "left")
        .where(F.col("_after").isNull() & (F.col("sequence") > F.col("_head") + 1))
        .groupBy(*chain)
        .agg(F.min("sequence").alias("_break"))
    )
    decided = staged.join(breaks, chain, "left").withColumn(
        "failure_code",
        F.coalesce(
            "failure_code",
            F.when(F.col("sequence") >= F.col("_break"), "PACKET_APPEND_GAP"),
        ),
    )
    columns = [*chain, *COLUMNS]
    accepted = decided.where(F.col("failure_code").isNull()).select(*columns)
    linked = chain_build(accepted, chain, packet_payload(), heads=heads.select(*chain, "head_sha256"))
    missing = F.lit(None).cast("string")
    return linked.withColumn("failure_code", missing).unionByName(
        decided.where(F.col("failure_code").isNotNull()).select(
            *columns,
            missing.alias("previous_entry_sha256"),
            missing.alias("entry_sha256"),
            "failure_code",
        )
    )


def stream_chain_append(
    packets: DataFrame,
    store_path: str,
    checkpoint: str,
    once: bool = True,
    chain: Sequence[str] = ("collection_id",),
    **limits: int | None,
) -> StreamingQuery:
    """Append a stream of packets to hash chains; entries and rejected rows go to ``store_path``.

    The rules are those of :func:`append_batch`, with each chain's head and identities as
    keyed state instead of a store that is read again: a batch costs what its own rows cost.
    """
    use_state_store(packets.sparkSession)
    chain = list(chain)
    before, after = canonical_split(packet_payload(), LINK_MEMBER)
    named = F.lit(True)
    for name in chain:
        named = named & F.col(name).isNotNull()
    fields = [packets.schema[name] for name in (*chain, *COLUMNS)]
    schema = T.StructType(
        [*fields, *(T.StructField(name, T.StringType()) for name in ("previous_entry_sha256", "entry_sha256", "failure_code"))]
    )
    linked = (
        packets.where(named)
        .select(*chain, *COLUMNS, before.alias("_before"), after.alias("_after"))
        .groupBy(*chain)
        .transformWithState(ChainAppender(chain, COLUMNS, IDENTITIES, **limits), schema, "Append", "None")
    )
    missing = F.lit(None).cast("string")
    unnamed = packets.where(~named).select(
        *chain, *COLUMNS, missing.alias("previous_entry_sha256"), missing.alias("entry_sha256"),
        F.lit("PACKET_INDEX_INVALID").alias("failure_code"),
    )
    return _start(linked.unionByName(unnamed), store_path, checkpoint, once)
