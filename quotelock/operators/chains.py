"""Hash chains: build, verify and the ordered checks on them.

A chain table has one row per entry: chain key columns, an integer ``sequence``, a
payload, a link to the predecessor's digest and its own digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelock.functions.digests import canonical_digest, canonical_split
from quotelock.functions.ladder import first_failure, holds
from quotelock.plans.blocks import copies_of_place, running_sum, with_previous

LINK_MEMBER = "previousEntrySha256"
LINK, ENTRY, SEQUENCE = "previous_entry_sha256", "entry_sha256", "sequence"
MAX_PACKETS = 100
MAX_COLLECTION_BYTES = 64 * 1024 * 1024


def _link_batches(chain_width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, previous = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(chain_width)]
            starts, befores, afters = (
                batch.column(name).to_pylist() for name in ("_start", "_before", "_after")
            )
            links, entries = [], []
            for row, start, before, after in zip(zip(*columns), starts, befores, afters):
                if row != current:
                    current, previous = row, start
                links.append(previous)
                value = "null" if previous is None else f'"{previous}"'
                previous = hashlib.sha256(f"{before}{value}{after}".encode()).hexdigest()
                entries.append(previous)
            kept = [name for name in batch.schema.names if name not in ("_start", "_before", "_after")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept]
                + [pa.array(links, pa.string()), pa.array(entries, pa.string())],
                names=[*kept, LINK, ENTRY],
            )

    return link


def chain_build(
    rows: DataFrame,
    chain: Sequence[str],
    payload: Mapping,
    sequence: str = SEQUENCE,
    link_member: str = LINK_MEMBER,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Give each row its link and digest; ``payload`` maps member names to columns.

    ``heads`` has the chain columns and ``head_sha256``: the digest a continued chain
    starts from. Members are encoded in parallel; only the digests are taken in
    order. Rows stream through a chain's task in sequence order with one digest as
    state, so a chain of any length needs no more memory than a batch. The digests of
    one chain depend on each other and cannot be spread further.
    """
    before, after = canonical_split(payload, link_member)
    staged = rows
    if heads is None:
        staged = staged.withColumn("_start", F.lit(None).cast("string"))
    else:
        known = heads.select(*chain, F.col("head_sha256").alias("_start"))
        staged = staged.join(known, list(chain), "left")
    others = [name for name in rows.columns if name not in chain]
    staged = staged.select(*chain, *others, "_start", before.alias("_before"), after.alias("_after"))
    schema = T.StructType(
        [rows.schema[name] for name in (*chain, *others)]
        + [T.StructField(LINK, T.StringType()), T.StructField(ENTRY, T.StringType())]
    )
    ordered = staged.repartition(*chain).sortWithinPartitions(*chain, sequence)
    return ordered.mapInArrow(_link_batches(len(chain)), schema)


def chain_findings(
    entries: DataFrame,
    chain: Sequence[str],
    payload: Mapping,
    sequence: str = SEQUENCE,
    link: str = LINK,
    entry: str = ENTRY,
    link_member: str = LINK_MEMBER,
) -> DataFrame:
    """One row per ``(chain, sequence)`` with the code of what is wrong there.

    Each entry's digest is recomputed from its own row. For the links every entry is
    sent to its own position and to the next one, and the two meet in one grouping
    by ``(chain, sequence)``: a chain is spread over all tasks, whatever its length.
    """
    number = F.col(sequence).cast("bigint")
    recomputed = canonical_digest({**payload, link_member: F.col(link)})
    intact = holds(recomputed == F.col(entry))
    missing = F.lit(None).cast("string")
    own = F.struct(
        number.alias("sequence"),
        F.lit(1).alias("own"),
        intact.alias("intact"),
        F.col(link).alias("link"),
        F.col(entry).alias("entry"),
        missing.alias("expected"),
    )
    following = F.struct(
        (number + 1).alias("sequence"),
        F.lit(0).alias("own"),
        F.lit(None).cast("boolean").alias("intact"),
        missing.alias("link"),
        missing.alias("entry"),
        F.col(entry).alias("expected"),
    )
    positions = (
        entries.select(*chain, F.inline(F.array(own, following)))
        .groupBy(*chain, "sequence")
        .agg(
            F.sum("own").alias("copies"),
            F.min("intact").alias("intact"),
            F.max("link").alias("link"),
            F.max("entry").alias("entry"),
            F.max("expected").alias("expected"),
        )
        .where(F.col("copies") > 0)
    )
    first = F.col("sequence") == 1
    code = first_failure(
        [
            (F.col("copies") == 1, "SEQUENCE_DUPLICATE"),
            (first | ((F.col("sequence") > 1) & F.col("expected").isNotNull()), "SEQUENCE_GAP"),
            (F.col("link").eqNullSafe(F.col("expected")), "LINK_MISMATCH"),
            (F.col("intact"), "HASH_MISMATCH"),
        ]
    )
    return positions.withColumn("failure_code", code)


def chain_verify(entries: DataFrame, chain: Sequence[str], payload: Mapping, **names: str) -> DataFrame:
    """Per chain: entry count, head, first broken sequence and its code.

    An entry without a sequence has no place, but its code still counts.
    """
    findings = chain_findings(entries, chain, payload, **names)
    broken = F.when(F.col("failure_code").isNotNull(), F.col("sequence"))
    return findings.groupBy(*chain).agg(
        F.sum("copies").alias("entries"),
        F.max_by("entry", "sequence").alias("head_sha256"),
        F.min(broken).alias("first_broken_sequence"),
        F.coalesce(F.min_by("failure_code", broken), F.min("failure_code")).alias("failure_code"),
    )


def duplicate_identities(
    entries: DataFrame, chain: Sequence[str], identities: Sequence[str]
) -> DataFrame:
    """Identity values that occur more than once in a chain."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("identity"), F.col(name).cast("string").alias("value"))
            for name in identities
        ]
    )
    return (
        entries.select(*chain, F.inline(pairs))
        .groupBy(*chain, "identity", "value")
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def running_bytes(
    entries: DataFrame,
    chain: Sequence[str],
    size: str = "source_byte_length",
    sequence: str = SEQUENCE,
    max_bytes: int | None = None,
) -> DataFrame:
    """Cumulative source bytes; rows past ``max_bytes``, or without a sum, carry BYTES_EXCEEDED."""
    summed = running_sum(entries, chain, sequence, F.col(size), "total_bytes")
    return summed.withColumn(
        "failure_code",
        first_failure(
            [
                (F.col(sequence).isNotNull(), "SEQUENCE_GAP"),
                (
                    F.col("total_bytes").isNotNull() if max_bytes is None else F.col("total_bytes") <= max_bytes,
                    "PACKET_COLLECTION_BYTES_EXCEEDED",
                ),
            ]
        ),
    )


def strictly_increasing(
    entries: DataFrame, chain: Sequence[str], key: Column, sequence: str = SEQUENCE
) -> DataFrame:
    """Rows whose ``key`` is not above that of their predecessor, or is unreadable.

    Only the row at sequence 1 may lack a predecessor. A place taken twice, and the place
    after it, are rejected, and so is a row without a sequence.
    """
    keyed = copies_of_place(entries.withColumn("_key", key), chain, sequence, "_place_copies")
    paired = with_previous(keyed, chain, sequence, {"key": F.col("_key")})
    previous, first = F.col("previous"), F.col(sequence) == 1
    code = first_failure(
        [
            (F.col("_key").isNotNull(), "VERSION_INVALID"),
            (F.col(sequence).isNotNull(), "SEQUENCE_GAP"),
            (F.col("_place_copies") == 1, "SEQUENCE_DUPLICATE"),
            (first | previous.isNotNull(), "SEQUENCE_GAP"),
            (first | (previous["key"] < F.col("_key")), "VERSION_NOT_INCREASING"),
        ]
    )
    return paired.withColumn("failure_code", code).drop("_key", "_place_copies", "previous")


def history_continuity(
    entries: DataFrame,
    chain: Sequence[str],
    pairs: Mapping[str, str],
    sequence: str = SEQUENCE,
    next_identity: str | None = None,
) -> DataFrame:
    """Each entry starts where its predecessor ended.

    ``pairs`` maps a ``previous_*`` column to the ``next_*`` column it must equal in the
    predecessor. Codes: DUPLICATE (the ``next_identity`` was reached before), FORK (several
    entries at one place), GAP (no predecessor, or several), CONTINUITY_MISMATCH (it starts
    elsewhere).
    """
    identity = next_identity or next(iter(pairs.values()))
    reached = entries.groupBy(*chain, identity).agg(F.min(sequence).alias("_first"))
    staged = copies_of_place(entries.join(reached, [*chain, identity], "left"), chain, sequence, "_place_copies")
    paired = with_previous(staged, chain, sequence, {name: F.col(name) for name in pairs.values()})
    previous = F.col("previous")
    equal = F.lit(True)
    for name, earlier in pairs.items():
        equal = equal & F.col(name).eqNullSafe(previous[earlier])
    first = F.col(sequence) == 1
    code = first_failure(
        [
            (F.col(sequence) == F.col("_first"), "HISTORY_DUPLICATE"),
            (F.col("_place_copies") == 1, "HISTORY_FORK"),
            (first | previous.isNotNull(), "HISTORY_GAP"),
            (first | equal, "HISTORY_CONTINUITY_MISMATCH"),
        ]
    )
    return paired.withColumn("failure_code", code).drop("_first", "_place_copies", "previous")


def collection_totals(
    entries: DataFrame,
    chain: Sequence[str],
    head: str = "packet_sha256",
    size: str = "source_byte_length",
    sequence: str = SEQUENCE,
) -> DataFrame:
    """Count, total bytes, first and last head per collection."""
    return entries.groupBy(*chain).agg(
        F.count("*").alias("packet_count"),
        F.sum(size).cast("bigint").alias("total_source_bytes"),
        F.min_by(head, sequence).alias("first_packet_sha256"),
        F.max_by(head, sequence).alias("last_packet_sha256"),
    )


def history_coverage(entries: DataFrame, chain: Sequence[str], sequence: str = SEQUENCE) -> DataFrame:
    """Where each transition history starts and ends."""
    return entries.groupBy(*chain).agg(
        F.count("*").alias("transition_count"),
        F.min_by("previous_bundle_sha256", sequence).alias("initial_bundle_sha256"),
        F.max_by("next_bundle_sha256", sequence).alias("latest_bundle_sha256"),
        F.min_by("previous_packet_count", sequence).alias("initial_packet_count"),
        F.max_by("next_packet_count", sequence).alias("latest_packet_count"),
        F.min_by("transition_audit_sha256", sequence).alias("first_transition_audit_sha256"),
        F.max_by("transition_audit_sha256", sequence).alias("last_transition_audit_sha256"),
    )


def exact_append(
    previous: DataFrame,
    following: DataFrame,
    chain: Sequence[str],
    digest: Column,
    sequence: str = SEQUENCE,
    head: str = "packet_sha256",
    max_appended: int | None = None,
) -> DataFrame:
    """``following`` must be ``previous`` unchanged plus at least one row, at most ``max_appended``.

    Both sides meet in one grouping by ``(chain, sequence)``; per chain only counts and
    the appended range remain.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            *chain,
            F.col(sequence).cast("bigint").alias("sequence"),
            F.lit(name).alias("side"),
            digest.alias("digest"),
            F.col(head).alias("head"),
        )

    before, after = F.col("side") == "previous", F.col("side") == "next"
    positions = (
        side(previous, "previous")
        .unionByName(side(following, "next"))
        .groupBy(*chain, "sequence")
        .agg(
            F.count_if(before).alias("before"),
            F.count_if(after).alias("after"),
            F.max(F.when(before, F.col("digest"))).alias("old"),
            F.max(F.when(after, F.col("digest"))).alias("new"),
            F.max(F.when(after, F.col("head"))).alias("head"),
        )
    )
    kept = (F.col("before") == 1) & (F.col("after") == 1) & F.col("old").eqNullSafe(F.col("new"))
    added = (F.col("before") == 0) & (F.col("after") == 1)
    added_sequence = F.when(added, F.col("sequence"))
    totals = positions.groupBy(*chain).agg(
        F.sum("before").alias("previous_count"),
        F.sum("after").alias("next_count"),
        F.count_if(added).alias("appended_count"),
        F.count_if(~kept & ~added).alias("_changed"),
        F.min(added_sequence).alias("first_sequence"),
        F.max(added_sequence).alias("last_sequence"),
        F.min_by("head", added_sequence).alias("first_packet_sha256"),
        F.max_by("head", added_sequence).alias("last_packet_sha256"),
    )
    code = first_failure(
        [
            (F.col("previous_count") > 0, "PACKET_COLLECTION_TRANSITION_MISMATCH"),
            (F.col("_changed") == 0, "PACKET_COLLECTION_TRANSITION_MISMATCH"),
            (
                (F.col("appended_count") >= 1)
                & (F.lit(True) if max_appended is None else F.col("appended_count") <= max_appended),
                "PACKET_COLLECTION_TRANSITION_MISMATCH",
            ),
            (
                (F.col("first_sequence") == F.col("previous_count") + 1)
                & (F.col("last_sequence") == F.col("next_count")),
                "PACKET_COLLECTION_TRANSITION_MISMATCH",
            ),
        ]
    )
    return totals.withColumn("failure_code", code).drop("_changed")
