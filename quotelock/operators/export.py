"""Exports: portable packets, collection bundles and the provenance graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import (
    Optional,
    canonical_digest,
    short_id,
    to_base64,
)
from quotelock.functions.ladder import at_most, first_failure
from quotelock.functions.records import (
    DEFAULT_NAMESPACE,
    PACKET_OBJECT_PATH,
    content_urn,
    object_path,
)
from quotelock.operators.gate import CANDIDATE_KIND, EVIDENCE_KIND, SELECTOR_TYPE
from quotelock.operators.heads import collection_heads
from quotelock.plans.blocks import join_with_nulls

SOURCE_NAME = "source.bin"
PROMOTION_POLICY = "verified-local-citation@1"


def view_members(view: Column) -> dict:
    return {
        "kind": view["kind"],
        "transformation": view["transformation"],
        "sourceSha256": view["source_sha256"],
        "mediaType": view["media_type"],
        "sha256": view["sha256"],
        "byteLength": view["byte_length"],
    }


def _selector() -> dict:
    c = F.col
    return {
        "type": F.lit(SELECTOR_TYPE),
        "exact": c("exact"),
        "prefix": c("prefix"),
        "suffix": c("suffix"),
    }


def packet_members(namespace: str = DEFAULT_NAMESPACE) -> dict:
    """Canonical members of a portable packet, from an evidence row with ``base64``."""
    c = F.col
    snapshot = {
        "mediaType": c("media_type"),
        "sha256": c("sha256"),
        "byteLength": c("byte_length"),
        "objectPath": F.lit(PACKET_OBJECT_PATH),
        "sourceUri": content_urn(c("sha256"), namespace),
        "capturedAt": c("captured_at"),
        "availableAt": c("available_at"),
    }
    view = Optional(view_members(c("citation_view")), c("citation_view").isNotNull())
    shared = {"snapshot": snapshot, "selector": _selector(), "citationView": view}
    return {
        "version": F.lit(1),
        "kind": F.lit("PortableEvidencePacket"),
        "source": {
            "name": F.lit(SOURCE_NAME),
            "mediaType": c("media_type"),
            "sha256": c("sha256"),
            "byteLength": c("byte_length"),
            "base64": c("base64"),
        },
        "candidate": {
            **shared,
            "kind": F.lit(CANDIDATE_KIND),
            "id": c("candidate_id"),
            "observedAt": c("observed_at"),
        },
        "evidence": {
            **shared,
            "kind": F.lit(EVIDENCE_KIND),
            "id": c("evidence_id"),
            "candidateId": c("candidate_id"),
            "observedAt": c("observed_at"),
            "verifiedAt": c("verified_at"),
        },
        "assurance": {"timestamp": F.lit("not-attested")},
    }


def packet_export(
    evidence: DataFrame, contents: DataFrame, namespace: str = DEFAULT_NAMESPACE
) -> DataFrame:
    """Join verified evidence to its bytes and make portable packets.

    ``contents`` has ``(snapshot_ref, content)``. Base64, size and digest are taken once per
    content, before the join. ``packet_sha256`` is the head over all fields; evidence whose
    bytes are missing or are not the claimed ones has a ``failure_code`` and no head.
    """
    content = F.col("content").cast("binary")
    encoded = contents.select(
        "snapshot_ref",
        to_base64(content).alias("base64"),
        F.octet_length(content).cast("bigint").alias("_length"),
        F.sha2(content, 256).alias("_sha256"),
    )
    code = first_failure(
        [
            (F.col("_sha256").isNotNull(), "SNAPSHOT_MISSING"),
            (F.col("_length") == F.col("byte_length"), "SNAPSHOT_SIZE_MISMATCH"),
            (F.col("_sha256") == F.col("sha256"), "SNAPSHOT_HASH_MISMATCH"),
        ]
    )
    joined = evidence.join(encoded, "snapshot_ref", "left").withColumn("failure_code", code)
    intact = F.col("failure_code").isNull()
    return joined.withColumns(
        {
            "packet_sha256": F.when(intact, canonical_digest(packet_members(namespace))),
            "object_path": F.lit(PACKET_OBJECT_PATH),
            "source_uri": content_urn(F.col("sha256"), namespace),
        }
    ).drop("_length", "_sha256")


def bundle_export(
    entries: DataFrame,
    collection: Sequence[str],
    max_packets: int | None = None,
    namespace: str = "Quotelock",
) -> DataFrame:
    """Nest the ordered entries and packets of each collection and give it its heads.

    A bundle is one record by definition, but its heads are streamed
    (:mod:`quotelock.operators.heads`). A collection with a missing, repeated or damaged
    entry or a repeated packet, or with more than ``max_packets`` entries where that is
    given, comes back with a code and without entries or heads; it is counted out before
    anything is gathered.
    """
    keys = list(collection)
    copies = entries.groupBy(*keys, "packet_sha256").agg(F.count("*").alias("_copies"))
    most = copies.groupBy(*keys).agg(F.max("_copies").alias("_copies"))
    heads = join_with_nulls(collection_heads(entries, keys, namespace), most, keys)
    counts = heads.select(
        *keys,
        F.col("entry_count").alias("packet_count"),
        first_failure(
            [
                (at_most(F.col("entry_count"), max_packets), "PACKET_COLLECTION_COUNT_INVALID"),
                (F.col("failure_code").isNull() & (F.col("_copies") == 1), "PACKET_COLLECTION_BUNDLE_INVALID"),
            ]
        ).alias("failure_code"),
        *[F.col(name) for name in ("index_sha256", "audit_sha256", "packets_sha256", "bundle_sha256")],
    )
    good = F.col("failure_code").isNull()
    for name in ("index_sha256", "audit_sha256", "packets_sha256", "bundle_sha256"):
        counts = counts.withColumn(name, F.when(good, F.col(name)))
    entry = F.struct(
        F.col("candidate_id").alias("candidateId"),
        F.col("entry_sha256").alias("entrySha256"),
        F.col("evidence_id").alias("evidenceId"),
        F.col("packet_sha256").alias("packetSha256"),
        F.col("previous_entry_sha256").alias("previousEntrySha256"),
        F.col("sequence").cast("bigint").alias("sequence"),
        F.col("source_byte_length").alias("sourceByteLength"),
        F.col("source_sha256").alias("sourceSha256"),
    )
    fitting = entries.join(counts.where(good).select(*keys), keys, "left_semi")
    placed = F.sort_array(F.collect_list(F.struct(F.col("sequence").alias("at"), entry.alias("entry"))))
    nested = fitting.groupBy(*keys).agg(F.transform(placed, lambda item: item["entry"]).alias("entries"))
    names = F.transform("entries", lambda item: F.concat(F.lit("packets/"), item["packetSha256"], F.lit(".json")))
    return counts.join(nested, keys, "left").withColumn("packet_names", names)


def provenance_export(
    evidence: DataFrame,
    protocol_commit: str,
    software: str = "quotelock@0.1.0",
    schema_version: str = "0.1.0",
    policy: str = f"quotelock/{PROMOTION_POLICY}",
) -> dict[str, DataFrame]:
    """Artifact vertices, promotion events and ``derived_from`` edges of evidence rows.

    Three projections of one table; every id follows from the evidence. Events carry
    ``previous_event_sha256`` when the evidence row does, else NULL.
    """
    c = F.col
    artifact_id = F.concat(F.lit("artifact:sha256:"), c("sha256"))
    evidence_ref = F.concat(F.lit("evidence:"), c("evidence_id"))
    event_id = short_id("evt_", F.concat(F.lit("promotion:"), c("evidence_id")))
    view = Optional(view_members(c("citation_view")), c("citation_view").isNotNull())
    payload = canonical_digest(
        {
            "promotionPolicy": F.lit(policy),
            "protocolCommit": F.lit(protocol_commit),
            "evidenceId": c("evidence_id"),
            "candidateId": c("candidate_id"),
            "sourceArtifactId": artifact_id,
            "selector": _selector(),
            "citationView": view,
            "availableAt": c("available_at"),
            "observedAt": c("observed_at"),
            "verifiedAt": c("verified_at"),
        }
    )
    previous = (
        c("previous_event_sha256")
        if "previous_event_sha256" in evidence.columns
        else F.lit(None).cast("string")
    )
    return {
        "artifacts": evidence.groupBy(artifact_id.alias("artifact_id")).agg(
            F.min(F.regexp_replace("media_type", r"\s+", "")).alias("media_type"),
            F.min("byte_length").alias("byte_length"),
            F.min(object_path(c("sha256"))).alias("locator"),
        ),
        "events": evidence.select(
            event_id.alias("event_id"),
            F.lit("evidence_promoted").alias("event_type"),
            F.lit(schema_version).alias("schema_version"),
            F.lit(software).alias("software"),
            c("verified_at").alias("occurred_at"),
            evidence_ref.alias("evidence_ref"),
            artifact_id.alias("artifact_ref"),
            payload.alias("payload_sha256"),
            previous.alias("previous_event_sha256"),
        ),
        "edges": evidence.select(
            short_id(
                "edge_", F.concat(F.lit("derived-from:"), c("evidence_id"), F.lit(":"), artifact_id)
            ).alias("edge_id"),
            F.lit("derived_from").alias("relationship"),
            evidence_ref.alias("from_ref"),
            artifact_id.alias("to_ref"),
            c("verified_at").alias("recorded_at"),
            event_id.alias("promotion_event_ref"),
        ),
    }
