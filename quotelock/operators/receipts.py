"""Retained receipts and reports: arithmetic invariants and their own digests.

A receipt table is flat. Each kind has its rules; the digest of a receipt is
recomputed from its fields and must equal the one it carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import Optional, canonical_digest, is_commit, is_digest
from quotelock.functions.instants import instant_key
from quotelock.functions.ladder import Rule, first_failure, holds, whole_number
from quotelock.functions.semver import is_semver, semver_key
from quotelock.operators.lineage import transition_digest
from quotelock.operators.releases import REVISIONS

REPORT_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"

# The checks an acceptance or continuity receipt must list as true.
ACCEPTANCE_CHECKS = (
    "validWorkspaceVerified",
    "partialConfigurationRejected",
    "mismatchedAuditRejected",
    "middleVersionRejected",
    "middlePackHeadRejected",
    "laggingHistoryRejected",
    "loopbackWorkspaceVerified",
)


def _hashes(*names: str) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & is_digest(F.col(name))
    return result


def _assurance() -> dict:
    return {"timestamp": F.lit("not-attested")}


def all_true(checks: Column, names: Sequence[str]) -> Column:
    """A check map has exactly these names, each true."""
    listed = F.array(*map(F.lit, sorted(names)))
    return holds(
        (F.array_sort(F.map_keys(checks)) == listed)
        & F.forall(F.map_values(checks), lambda value: F.coalesce(value, F.lit(False)))
    )


def _times(bound: int | None, factor: int = 1, less: int = 0) -> int | None:
    """A bound that follows from another, None when that is not set."""
    return None if bound is None else bound * factor - less


def transition_rules(max_packets: int | None = None, namespace: str = "Quotelock") -> list[Rule]:
    c = F.col
    invalid = "PACKET_COLLECTION_TRANSITION_SCHEMA_INVALID"
    return [
        (
            _hashes(
                "previous_bundle_sha256",
                "next_bundle_sha256",
                "previous_index_sha256",
                "next_index_sha256",
                "first_packet_sha256",
                "last_packet_sha256",
            ),
            invalid,
        ),
        (
            whole_number(c("previous_packet_count"), 1, max_packets)
            & whole_number(c("next_packet_count"), 1, max_packets)
            & whole_number(c("appended_packet_count"), 1, _times(max_packets, less=1))
            & whole_number(c("first_sequence"), 2, max_packets)
            & whole_number(c("last_sequence"), 2, max_packets),
            invalid,
        ),
        (
            c("next_packet_count") == c("previous_packet_count") + c("appended_packet_count"),
            invalid,
        ),
        (c("first_sequence") == c("previous_packet_count") + 1, invalid),
        (c("last_sequence") == c("next_packet_count"), invalid),
        (
            (c("previous_bundle_sha256") != c("next_bundle_sha256"))
            & (c("previous_index_sha256") != c("next_index_sha256")),
            invalid,
        ),
        (
            transition_digest(namespace) == c("receipt_sha256"),
            "PACKET_COLLECTION_TRANSITION_INTEGRITY_INVALID",
        ),
    ]


def history_audit_digest(namespace: str = "Quotelock") -> Column:
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}EvidencePacketTransitionHistoryAuditReceipt"),
            "outcome": F.lit("verified"),
            "history": {
                "indexSha256": c("index_sha256"),
                "transitionCount": c("transition_count"),
            },
            "coverage": {
                "initialBundleSha256": c("initial_bundle_sha256"),
                "latestBundleSha256": c("latest_bundle_sha256"),
                "initialPacketCount": c("initial_packet_count"),
                "latestPacketCount": c("latest_packet_count"),
                "firstTransitionAuditSha256": c("first_transition_audit_sha256"),
                "lastTransitionAuditSha256": c("last_transition_audit_sha256"),
            },
            "assurance": _assurance(),
        }
    )


def history_audit_rules(max_packets: int | None = None, namespace: str = "Quotelock") -> list[Rule]:
    c = F.col
    invalid = "PACKET_TRANSITION_HISTORY_AUDIT_SCHEMA_INVALID"
    same_transition = c("first_transition_audit_sha256") == c("last_transition_audit_sha256")
    return [
        (
            _hashes(
                "index_sha256",
                "initial_bundle_sha256",
                "latest_bundle_sha256",
                "first_transition_audit_sha256",
                "last_transition_audit_sha256",
            ),
            invalid,
        ),
        (
            whole_number(c("transition_count"), 1, _times(max_packets, less=1))
            & whole_number(c("initial_packet_count"), 1, _times(max_packets, less=1))
            & whole_number(c("latest_packet_count"), 2, max_packets),
            invalid,
        ),
        (
            c("latest_packet_count") - c("initial_packet_count") >= c("transition_count"),
            invalid,
        ),
        (c("initial_bundle_sha256") != c("latest_bundle_sha256"), invalid),
        ((c("transition_count") == 1) == same_transition, invalid),
        (
            history_audit_digest(namespace) == c("receipt_sha256"),
            "PACKET_TRANSITION_HISTORY_AUDIT_INTEGRITY_INVALID",
        ),
    ]


def _check_members(checks: Sequence[str]) -> dict:
    return {name: F.lit(True) for name in checks}


def continuity_digest(checks: Sequence[str], namespace: str = "Quotelock") -> Column:
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}CrossReleaseLineageAcceptanceReceipt"),
            "outcome": F.lit("verified"),
            "releases": {
                "older": {"version": c("older_version"), "packSha256": c("older_pack_sha256")},
                "newer": {"version": c("newer_version"), "packSha256": c("newer_pack_sha256")},
            },
            "lineage": {
                "previousSha256": c("previous_lineage_sha256"),
                "nextSha256": c("next_lineage_sha256"),
                "previousPacketCount": c("previous_packet_count"),
                "nextPacketCount": c("next_packet_count"),
                "previousTransitionCount": c("previous_transition_count"),
                "nextTransitionCount": c("next_transition_count"),
            },
            "checks": _check_members(checks),
            "assurance": _assurance(),
        }
    )


def continuity_rules(
    checks: Sequence[str], max_packets: int | None = None, namespace: str = "Quotelock"
) -> list[Rule]:
    c = F.col
    invalid = "LINEAGE_CONTINUITY_RECEIPT_SCHEMA_INVALID"
    older, newer = (semver_key(c(f"{side}_version"), allow_prerelease=False) for side in ("older", "newer"))
    return [
        (
            _hashes(
                "older_pack_sha256",
                "newer_pack_sha256",
                "previous_lineage_sha256",
                "next_lineage_sha256",
            ),
            invalid,
        ),
        (holds(older < newer) & (c("older_pack_sha256") != c("newer_pack_sha256")), invalid),
        (c("previous_lineage_sha256") != c("next_lineage_sha256"), invalid),
        (
            whole_number(c("previous_packet_count"), 2, _times(max_packets, less=1))
            & whole_number(c("next_packet_count"), 3, max_packets),
            invalid,
        ),
        (c("next_packet_count") == c("previous_packet_count") + 1, invalid),
        (
            (c("previous_transition_count") == c("previous_packet_count") - 1)
            & (c("next_transition_count") == c("next_packet_count") - 1),
            invalid,
        ),
        (all_true(c("checks"), checks), invalid),
        (
            continuity_digest(checks, namespace) == c("receipt_sha256"),
            "LINEAGE_CONTINUITY_RECEIPT_INTEGRITY_INVALID",
        ),
    ]


def acceptance_digest(checks: Sequence[str] = ACCEPTANCE_CHECKS, namespace: str = "Quotelock") -> Column:
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}PackedWorkspaceAcceptanceReceipt"),
            "outcome": F.lit("verified"),
            "package": {
                "version": c("package_version"),
                "packSha256": c("pack_sha256"),
                "capabilitiesManifestSha256": c("manifest_sha256"),
                "coverageContractSchemaSha256": c("schema_sha256"),
            },
            "archives": {
                "releaseIndexSha256": c("release_index_sha256"),
                "archiveAuditReceiptSha256": c("archive_audit_sha256"),
                "upgradeHistoryIndexSha256": c("upgrade_index_sha256"),
                "upgradeHistoryAuditReceiptSha256": c("upgrade_audit_sha256"),
            },
            "coverage": {
                "releaseCount": c("release_count"),
                "transitionCount": c("transition_count"),
                "firstRelease": c("first_release"),
                "latestRelease": c("latest_release"),
            },
            "checks": _check_members(checks),
            "assurance": _assurance(),
        }
    )


def acceptance_rules(
    checks: Sequence[str] = ACCEPTANCE_CHECKS, max_releases: int | None = None, namespace: str = "Quotelock"
) -> list[Rule]:
    c = F.col
    invalid = "WORKSPACE_RECEIPT_SCHEMA_INVALID"
    return [
        (
            is_semver(c("package_version"))
            & _hashes("pack_sha256", "manifest_sha256", "schema_sha256"),
            invalid,
        ),
        (
            _hashes(
                "release_index_sha256",
                "archive_audit_sha256",
                "upgrade_index_sha256",
                "upgrade_audit_sha256",
            ),
            invalid,
        ),
        (
            whole_number(c("release_count"), 2, max_releases)
            & whole_number(c("transition_count"), 1, _times(max_releases, less=1)),
            invalid,
        ),
        (c("transition_count") == c("release_count") - 1, invalid),
        (semver_key(c("first_release")) < semver_key(c("latest_release")), invalid),
        (all_true(c("checks"), checks), invalid),
        (
            acceptance_digest(checks, namespace) == c("receipt_sha256"),
            "WORKSPACE_RECEIPT_INTEGRITY_INVALID",
        ),
    ]


def collection_audit_digest(namespace: str = "Quotelock") -> Column:
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}EvidencePacketCollectionAuditReceipt"),
            "outcome": F.lit("verified"),
            "index": {"indexSha256": c("index_sha256"), "entryCount": c("entry_count")},
            "collection": {
                "verifiedPacketCount": c("packet_count"),
                "firstPacketSha256": c("first_packet_sha256"),
                "lastPacketSha256": c("last_packet_sha256"),
                "totalSourceBytes": c("total_source_bytes"),
            },
            "assurance": _assurance(),
        }
    )


def collection_audit_rules(
    max_packets: int | None = None, max_bytes: int | None = None, namespace: str = "Quotelock"
) -> list[Rule]:
    c = F.col
    invalid = "PACKET_COLLECTION_AUDIT_INVALID"
    return [
        (_hashes("index_sha256", "first_packet_sha256", "last_packet_sha256"), invalid),
        (whole_number(c("entry_count"), 1, max_packets), invalid),
        (c("packet_count") == c("entry_count"), invalid),
        (whole_number(c("total_source_bytes"), 0, max_bytes), invalid),
        (collection_audit_digest(namespace) == c("receipt_sha256"), invalid),
    ]


def archive_audit_digest(namespace: str = "Quotelock") -> Column:
    c = F.col
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}ReleaseArchiveAuditReceipt"),
            "outcome": F.lit("verified"),
            "index": {"indexSha256": c("index_sha256"), "entryCount": c("entry_count")},
            "archive": {
                "verifiedPackCount": c("verified_pack_count"),
                "firstRelease": c("first_release"),
                "latestRelease": c("latest_release"),
            },
            "signatures": {
                "provenanceVerifiedCount": c("provenance_verified_count"),
                "reviewVerifiedCount": c("review_verified_count"),
            },
            "trust": {
                "manualCount": c("manual_count"),
                "rotationHistoryCount": c("rotation_history_count"),
            },
            "assurance": _assurance(),
        }
    )


def archive_audit_rules(max_packs: int | None = None, namespace: str = "Quotelock") -> list[Rule]:
    c = F.col
    invalid = "ARCHIVE_RECEIPT_SCHEMA_INVALID"
    return [
        (_hashes("index_sha256"), invalid),
        (whole_number(c("entry_count"), 1, max_packs), invalid),
        (c("verified_pack_count") == c("entry_count"), invalid),
        (is_semver(c("first_release")) & is_semver(c("latest_release")), invalid),
        (c("provenance_verified_count") == c("verified_pack_count"), invalid),
        (whole_number(c("review_verified_count"), 1, _times(max_packs, 32)), invalid),
        (
            whole_number(c("manual_count"), 0, max_packs)
            & whole_number(c("rotation_history_count"), 0, max_packs),
            invalid,
        ),
        (c("manual_count") + c("rotation_history_count") == c("verified_pack_count"), invalid),
        (archive_audit_digest(namespace) == c("receipt_sha256"), "ARCHIVE_RECEIPT_INTEGRITY_INVALID"),
    ]


def receipt_validate(receipts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Check receipts of one kind by the rules of that kind."""
    return receipts.withColumn("failure_code", first_failure(rules))


def report_members(revisions: Sequence[str] = REVISIONS) -> dict:
    """Canonical members of an acceptance report row."""
    c = F.col
    return {
        "version": c("version"),
        "outcome": c("outcome"),
        "eventCount": c("event_count"),
        "trustedHeadSha256": c("trusted_head_sha256"),
        "recordedAt": Optional(c("recorded_at")),
        "candidateKind": c("candidate_kind"),
        "evidenceKind": c("evidence_kind"),
        "candidateLinked": c("candidate_linked"),
        "revisions": {
            name: {"commit": c(f"{name}_commit"), "clean": c(f"{name}_clean")} for name in revisions
        },
    }


def report_validate(reports: DataFrame, revisions: Sequence[str] = REVISIONS) -> DataFrame:
    """Acceptance reports: fixed values, head, time, revisions and own digest if present."""
    c = F.col
    recorded = c("recorded_at")
    with_zone = F.when(F.contains(recorded, F.lit(".")), recorded).otherwise(
        F.concat(F.substring(recorded, 1, 19), F.lit(".000Z"))
    )
    rules: list[Rule] = [
        (
            (c("version") == 1)
            & (c("outcome") == "verified")
            & (c("event_count") == 4)
            & (c("candidate_kind") == "EvidenceCandidate")
            & (c("evidence_kind") == "VerifiedEvidence")
            & c("candidate_linked"),
            "REPORT_SCHEMA_INVALID",
        ),
        (is_digest(c("trusted_head_sha256")), "REPORT_SCHEMA_INVALID"),
        (
            recorded.isNull()
            | (recorded.rlike(REPORT_TIME_PATTERN) & instant_key(with_zone).isNotNull()),
            "REPORT_TIME_INVALID",
        ),
        *[
            (is_commit(c(f"{name}_commit")) & c(f"{name}_clean").isNotNull(), "REPORT_REVISION_INVALID")
            for name in revisions
        ],
        (
            c("report_sha256").isNull()
            | (canonical_digest(report_members(revisions)) == c("report_sha256")),
            "REPORT_INTEGRITY_INVALID",
        ),
    ]
    return reports.withColumn("failure_code", first_failure(rules))
