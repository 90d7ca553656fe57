"""Lineages: a collection, its transition history and the audits that bind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest
from quotelock.functions.ladder import first_failure, holds
from quotelock.operators.audits import any_failure, collection_audit, history_audit, latest_entry
from quotelock.operators.chains import chain_build, history_continuity
from quotelock.operators.heads import CONTINUITY, collection_heads, history_heads, lineage_head, prefix_heads
from quotelock.plans.blocks import join_with_nulls
from quotelock.plans.checkpoints import cut_lineage

PACKET_PAYLOAD_COLUMNS = {
    "sequence": "sequence",
    "packetSha256": "packet_sha256",
    "sourceSha256": "source_sha256",
    "sourceByteLength": "source_byte_length",
    "candidateId": "candidate_id",
    "evidenceId": "evidence_id",
}
TRANSITION_PAYLOAD_COLUMNS = {
    "sequence": "sequence",
    "transitionAuditSha256": "transition_audit_sha256",
    "previousBundleSha256": "previous_bundle_sha256",
    "nextBundleSha256": "next_bundle_sha256",
    "previousIndexSha256": "previous_index_sha256",
    "nextIndexSha256": "next_index_sha256",
    "previousPacketCount": "previous_packet_count",
    "nextPacketCount": "next_packet_count",
    "appendedPacketCount": "appended_packet_count",
}


def members(columns: dict[str, str]) -> dict[str, Column]:
    return {name: F.col(column) for name, column in columns.items()}


def packet_payload() -> dict[str, Column]:
    return members(PACKET_PAYLOAD_COLUMNS)


def transition_payload() -> dict[str, Column]:
    return members(TRANSITION_PAYLOAD_COLUMNS)


def transition_digest(namespace: str = "Quotelock") -> Column:
    """Digest of a transition receipt row."""
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}EvidencePacketCollectionTransitionAuditReceipt"),
            "outcome": F.lit("verified"),
            "previous": {
                "bundleSha256": c("previous_bundle_sha256"),
                "indexSha256": c("previous_index_sha256"),
                "packetCount": c("previous_packet_count"),
            },
            "next": {
                "bundleSha256": c("next_bundle_sha256"),
                "indexSha256": c("next_index_sha256"),
                "packetCount": c("next_packet_count"),
            },
            "append": {
                "packetCount": c("appended_packet_count"),
                "firstSequence": c("first_sequence"),
                "lastSequence": c("last_sequence"),
                "firstPacketSha256": c("first_packet_sha256"),
                "lastPacketSha256": c("last_packet_sha256"),
            },
            "assurance": {"timestamp": F.lit("not-attested")},
        }
    )


def append_packets(
    current: DataFrame,
    packets: DataFrame,
    chain: Sequence[str],
    max_entries: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Continue each chain of ``current`` with the new ``packets``.

    ``packets`` has the chain columns, ``append_order`` from 1 and the payload columns
    but the sequence. Chains that would pass ``max_entries`` or ``max_bytes``, repeat an
    identity, have no key, or whose orders are not 1 to n, each once, keep none of their new
    rows: those come back with a ``failure_code``.
    """
    chain = list(chain)
    heads = current.groupBy(*chain).agg(
        F.max_by("entry_sha256", "sequence").alias("head_sha256"),
        F.max("sequence").cast("bigint").alias("head_sequence"),
        F.sum("source_byte_length").alias("_bytes"),
    )
    identities = ["packet_sha256", "candidate_id", "evidence_id"]
    known = current.select(*chain, *identities, F.lit(0).alias("_new"))
    fresh = packets.select(*chain, *identities, F.lit(1).alias("_new"))
    both = known.unionByName(fresh).select(
        *chain,
        "_new",
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("identity"), F.col(n).alias("value")) for n in identities])
        ),
    )
    repeated = (
        both.groupBy(*chain, "identity", "value")
        .agg(F.count("*").alias("_copies"), F.max("_new").alias("_new"))
        .where((F.col("_copies") > 1) & (F.col("_new") == 1))
        .select(*chain)
        .distinct()
        .withColumn("_repeated", F.lit(True))
    )
    added = (
        packets.groupBy(*chain, "append_order")
        .agg(F.count("*").alias("_rows"), F.sum("source_byte_length").alias("_size"))
        .groupBy(*chain)
        .agg(
            F.sum("_rows").alias("_added"),
            F.sum("_size").alias("_added_bytes"),
            F.min("append_order").alias("_first"),
            F.max("append_order").alias("_last"),
            F.count("append_order").alias("_orders"),
        )
    )
    full, heavy = F.lit(True), F.lit(True)
    if max_entries is not None:
        full = F.coalesce("head_sequence", F.lit(0)) + F.col("_added") <= max_entries
    if max_bytes is not None:
        heavy = F.coalesce("_bytes", F.lit(0)) + F.col("_added_bytes") <= max_bytes
    limits = (
        added.join(heads, chain, "left")
        .join(repeated, chain, "left")
        .withColumn(
            "failure_code",
            first_failure(
                [
                    (
                        (F.col("_first") == 1)
                        & (F.col("_last") == F.col("_added"))
                        & (F.col("_orders") == F.col("_added")),
                        "PACKET_APPEND_GAP",
                    ),
                    (full, "PACKET_INDEX_FULL"),
                    (heavy, "PACKET_COLLECTION_BYTES_EXCEEDED"),
                    (F.col("_repeated").isNull(), "PACKET_INDEX_DUPLICATE"),
                ]
            ),
        )
        .select(*chain, F.coalesce("head_sequence", F.lit(0)).alias("_base"), "failure_code")
    )
    staged = packets.join(limits, chain, "left").withColumns(
        {
            "sequence": F.col("_base") + F.col("append_order"),
            "failure_code": F.when(F.col("_base").isNull(), "PACKET_INDEX_INVALID").otherwise(F.col("failure_code")),
        }
    )
    accepted = staged.where(F.col("failure_code").isNull()).drop("_base", "append_order")
    linked = chain_build(
        accepted, chain, packet_payload(), heads=heads.select(*chain, "head_sha256")
    )
    rejected = (
        staged.where(F.col("failure_code").isNotNull())
        .drop("_base", "append_order")
        .withColumns(
            {
                "previous_entry_sha256": F.lit(None).cast("string"),
                "entry_sha256": F.lit(None).cast("string"),
            }
        )
    )
    return linked.unionByName(rejected)


def append_transitions(current: DataFrame, receipts: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Extend each history by verified transition receipts, in order, as one operation.

    ``receipts`` has the chain columns, ``append_order`` from 1 and the receipt's columns. A
    receipt must start where its predecessor ended: the last entry of the history, or the
    receipt before it. Histories whose orders are not 1 to n each once, or that break
    anywhere, get none of their new rows: all come back with the first code.
    """
    chain = list(chain)
    columns = list(TRANSITION_PAYLOAD_COLUMNS.values())
    heads = latest_entry(current.select(*chain, *columns, "entry_sha256"), chain)
    orders = (
        receipts.groupBy(*chain, "append_order")
        .agg(F.count("*").alias("_rows"))
        .groupBy(*chain)
        .agg(
            F.sum("_rows").alias("_added"), F.count("append_order").alias("_orders"),
            F.min("append_order").alias("_low"), F.max("append_order").alias("_high"),
        )
    )
    base = heads.select(*chain, F.col("sequence").cast("bigint").alias("_base"), F.col("entry_sha256").alias("head_sha256"))
    placed = cut_lineage(
        join_with_nulls(join_with_nulls(receipts, orders, chain), base, chain)
        .withColumn("_base", F.coalesce("_base", F.lit(0)))
        .withColumn("sequence", F.col("_base") + F.col("append_order"))
    )
    known = heads.select(*chain, *columns).withColumn("_new", F.lit(False))
    staged = known.unionByName(placed.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    # The last entry stands for the whole history before it.
    first = staged.withColumn("_own", F.col("sequence")).withColumn(
        "sequence", F.when(F.col("_new"), F.col("_own") - F.col("_base") + F.when(F.col("_base") > 0, 1).otherwise(0)).otherwise(F.lit(1))
    )
    checked = history_continuity(first, chain, dict(CONTINUITY)).withColumn("sequence", F.col("_own")).where("_new")
    named = F.lit(True)
    for name in chain:
        named = named & F.col(name).isNotNull()
    ordered = (F.col("_low") == 1) & (F.col("_high") == F.col("_added")) & (F.col("_orders") == F.col("_added"))
    # Read three times below.
    coded = cut_lineage(
        checked.withColumn(
            "failure_code",
            F.coalesce(first_failure([(named, "HISTORY_INVALID"), (ordered, "HISTORY_GAP")]), F.col("failure_code")),
        )
    )
    worst = coded.groupBy(*chain).agg(
        F.coalesce(F.min_by("failure_code", F.when(F.col("failure_code").isNotNull(), F.col("append_order"))), F.min("failure_code")).alias("_worst")
    )
    decided = join_with_nulls(coded.drop("failure_code"), worst, chain)
    out = [*chain, *columns]
    accepted = decided.where(F.col("_worst").isNull()).select(*out)
    missing = F.lit(None).cast("string")
    linked = chain_build(accepted, chain, transition_payload(), heads=base.select(*chain, "head_sha256"))
    rejected = decided.where(F.col("_worst").isNotNull()).select(
        *out, missing.alias("previous_entry_sha256"), missing.alias("entry_sha256"), F.col("_worst").alias("failure_code")
    )
    return linked.withColumn("failure_code", missing).unionByName(rejected)


def _receipt_columns() -> list[Column]:
    """A transition receipt from ``previous_`` and own heads and the appended range."""
    c = F.col
    return [
        c("previous_bundle_sha256"), c("bundle_sha256").alias("next_bundle_sha256"),
        c("previous_index_sha256"), c("index_sha256").alias("next_index_sha256"),
        c("previous_packet_count"), c("packet_count").alias("next_packet_count"),
        (c("packet_count") - c("previous_packet_count")).alias("appended_packet_count"),
        (c("previous_packet_count") + 1).alias("first_sequence"), c("packet_count").alias("last_sequence"),
        c("_first").alias("first_packet_sha256"), c("_last").alias("last_packet_sha256"),
    ]


def transitions_of(entries: DataFrame, chain: Sequence[str], namespace: str = "Quotelock") -> DataFrame:
    """One transition receipt per appended entry: collection n to n + 1, with the heads of both.

    Entries from a fault on give none.
    """
    heads = prefix_heads(entries, chain, namespace).where((F.col("packet_count") > 1) & F.col("failure_code").isNull())
    receipts = heads.withColumns({"_first": F.col("packet_sha256"), "_last": F.col("packet_sha256")}).select(
        *chain, F.col("previous_packet_count").alias("sequence"), *_receipt_columns()
    )
    return receipts.withColumn("transition_audit_sha256", transition_digest(namespace))


def append_lineage(
    current: DataFrame,
    history: DataFrame,
    packets: DataFrame,
    chain: Sequence[str],
    namespace: str = "Quotelock",
    **limits: int | None,
) -> dict[str, DataFrame]:
    """Append packets to collections and the transition to their histories, in one operation.

    Returns ``entries`` (the new packet entries, rejected ones with a code), ``receipts`` (one
    per collection that grew: from its old bundle head to its new one) and ``history`` (the
    new history entries, or why there are none).
    """
    chain = list(chain)
    # Each is read several times below; without a cut every reader would append again.
    added = cut_lineage(append_packets(current, packets, chain, **limits))
    columns = [*chain, *PACKET_PAYLOAD_COLUMNS.values(), "previous_entry_sha256", "entry_sha256"]
    grown = added.where(F.col("failure_code").isNull()).select(*columns)
    both = current.select(*columns).join(grown.select(*chain).distinct(), chain, "left_semi").unionByName(grown)
    marks = grown.groupBy(*chain).agg(F.min("sequence").alias("_from"))
    heads = prefix_heads(both, chain, namespace).join(marks, chain).where(F.col("failure_code").isNull())
    old, new = F.col("sequence") < F.col("_from"), F.col("sequence") >= F.col("_from")
    names = ("bundle_sha256", "index_sha256", "packet_count")
    ends = heads.groupBy(*chain).agg(
        *[F.max_by(name, F.when(old, F.col("sequence"))).alias(f"previous_{name}") for name in names],
        *[F.max_by(name, F.when(new, F.col("sequence"))).alias(name) for name in names],
        F.min_by("packet_sha256", F.when(new, F.col("sequence"))).alias("_first"),
        F.max_by("packet_sha256", F.when(new, F.col("sequence"))).alias("_last"),
    )
    receipts = (
        ends.where("previous_packet_count is not null")
        .select(*chain, *_receipt_columns())
        .withColumn("transition_audit_sha256", transition_digest(namespace))
    )
    receipts = cut_lineage(receipts)
    extended = append_transitions(history, receipts.withColumn("append_order", F.lit(1).cast("bigint")), chain)
    return {"entries": added, "receipts": receipts, "history": extended}


def lineage_verify(
    entries: DataFrame,
    history: DataFrame,
    receipts: DataFrame,
    chain: Sequence[str],
    supplied: DataFrame | None = None,
    expected: DataFrame | None = None,
    namespace: str = "Quotelock",
) -> DataFrame:
    """Verify every lineage: both chains, their heads, continuity, receipts and endpoint.

    One row per lineage with the first failing code. ``entries`` is the packet chain,
    ``history`` the transition chain and ``receipts`` the retained transition receipts with
    their ``position``. ``supplied`` packets (with ``position``) are audited against the
    entries, and ``expected`` (chain, ``expected_sha256``) holds the retained lineage heads:
    both are checked only where given, the heads before everything else. A lineage of
    ``expected`` that is not there gives a row too.
    """
    chain = list(chain)
    packets = collection_heads(entries, chain, namespace).select(
        *chain,
        F.col("entry_count").alias("packet_count"),
        F.col("index_sha256").alias("index_head"),
        "bundle_sha256",
        F.col("failure_code").alias("_packets"),
    )
    transitions = history_heads(history, chain, namespace)
    again = (
        history.groupBy(*chain, "next_bundle_sha256")
        .agg(F.count("*").alias("_copies"))
        .where("_copies > 1")
        .select(*chain, F.lit("HISTORY_DUPLICATE").alias("_again"))
        .distinct()
    )
    joined = packets.join(transitions, chain, "left").join(again, chain, "left")
    audited = history_audit(history, receipts, chain).where(F.col("verdict") != "VERIFIED")
    findings = any_failure(audited.withColumn("failure_code", F.col("verdict")), chain, F.col("position"))
    joined = joined.join(findings.withColumnRenamed("failure_code", "_audit"), chain, "left")
    rules = []
    if supplied is not None:
        found = collection_audit(entries, supplied, chain).where(F.col("verdict") != "VERIFIED")
        found = any_failure(found.withColumn("failure_code", F.col("verdict")), chain, F.col("position"))
        joined = joined.join(found.withColumnRenamed("failure_code", "_supplied"), chain, "left")
        rules.append(F.col("_supplied"))
    joined = joined.withColumn("lineage_sha256", F.when(F.col("bundle_sha256").isNotNull(), lineage_head(namespace)))
    head = F.lit(None).cast("string")
    if expected is not None:
        retained = expected.select(*chain, "expected_sha256", F.lit(True).alias("_retained"))
        joined = joined.withColumn("_there", F.lit(True)).join(retained, chain, "full")
        head = first_failure(
            [
                (F.col("_there") & F.col("_retained"), "PACKET_LINEAGE_ANCHORS_INVALID"),
                (F.col("lineage_sha256") == F.col("expected_sha256"), "PACKET_LINEAGE_HEAD_MISMATCH"),
            ]
        )
    endpoint = first_failure(
        [
            (F.col("bundle_sha256") == F.col("next_bundle_sha256"), "PACKET_LINEAGE_ENDPOINT_HEAD_MISMATCH"),
            (F.col("packet_count") == F.col("next_packet_count"), "PACKET_LINEAGE_ENDPOINT_COUNT_MISMATCH"),
        ]
    )
    code = F.coalesce(
        F.col("_packets"),
        F.when(holds(F.col("transition_count") >= 1), F.col("history_code")).otherwise(F.lit("PACKET_LINEAGE_INVALID")),
        F.col("_again"),
        F.col("continuity_code"),
        F.col("_audit"),
        *rules,
        endpoint,
        head,
    )
    return joined.select(
        *chain,
        F.coalesce("packet_count", F.lit(0)).alias("packet_count"),
        F.coalesce("transition_count", F.lit(0)).alias("transition_count"),
        "index_head",
        "bundle_sha256",
        F.when(code.isNull(), F.col("lineage_sha256")).alias("lineage_sha256"),
        code.alias("failure_code"),
    )
