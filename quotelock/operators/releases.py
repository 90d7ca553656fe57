"""Releases: manifest differences, cross links, upgrade bindings and benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest, is_commit, is_digest, is_text, packed
from quotelock.functions.ladder import first_failure, holds
from quotelock.functions.semver import bump_rank, is_semver, semver_bump, semver_key

CHECKPOINTS = (10, 25, 50, 100)


def manifest_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of two manifests as added, removed, changed or unchanged.

    Both sides have the key columns and ``digest``; they meet in one grouping. An item
    without a key or a digest, or listed twice on one side, is ``invalid``.
    """
    sides = previous.select(*keys, "digest", F.lit(True).alias("_old")).unionByName(
        current.select(*keys, "digest", F.lit(False).alias("_old"))
    )
    paired = sides.groupBy(*keys).agg(
        F.max(F.when(F.col("_old"), F.col("digest"))).alias("previous_digest"),
        F.max(F.when(~F.col("_old"), F.col("digest"))).alias("current_digest"),
        F.count_if("_old").alias("_before"),
        F.count_if(~F.col("_old")).alias("_after"),
        F.count("digest").alias("_digests"),
    )
    readable = (F.col("_before") <= 1) & (F.col("_after") <= 1) & (F.col("_digests") == F.col("_before") + F.col("_after"))
    for key in keys:
        readable = readable & F.col(key).isNotNull()
    before, after = F.col("previous_digest"), F.col("current_digest")
    return paired.withColumn(
        "change",
        F.when(~readable, "invalid")
        .when(before.isNull(), "added")
        .when(after.isNull(), "removed")
        .when(before != after, "changed")
        .otherwise("unchanged"),
    ).drop("_before", "_after", "_digests")


def manifest_compatibility(diff: DataFrame, versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome and version policy per manifest pair.

    Removed and changed items are breaking (major), added ones need a minor bump.
    ``versions`` has the key columns, ``previous_version`` and ``current_version``.
    """
    change = F.col("change")
    totals = diff.groupBy(*keys).agg(
        F.count_if(change == "added").alias("added"),
        F.count_if(change == "removed").alias("removed"),
        F.count_if(change == "changed").alias("changed"),
        F.count_if(change == "invalid").alias("_invalid"),
    )
    breaking = (F.col("removed") > 0) | (F.col("changed") > 0)
    required = F.when(breaking, "major").when(F.col("added") > 0, "minor").otherwise("patch")
    before, after = F.col("previous_version"), F.col("current_version")
    return (
        versions.join(totals, list(keys), "left")
        .withColumns({name: F.coalesce(name, F.lit(0)) for name in ("added", "removed", "changed", "_invalid")})
        .withColumns(
            {
                "outcome": F.when(breaking, "breaking").otherwise("compatible"),
                "required_bump": required,
                "actual_bump": semver_bump(before, after),
            }
        )
        .withColumn(
            "satisfied", holds(bump_rank(F.col("actual_bump")) >= bump_rank(F.col("required_bump")))
        )
        .withColumn(
            "failure_code",
            first_failure(
                [
                    (F.col("_invalid") == 0, "CAPABILITY_SCHEMA_INVALID"),
                    (is_semver(before) & is_semver(after), "CAPABILITY_SCHEMA_INVALID"),
                    (semver_key(before) < semver_key(after), "CAPABILITY_VERSION_NOT_INCREASING"),
                ]
            ),
        )
        .drop("_invalid")
    )


def pack_crosslinks(
    statements: DataFrame,
    bundles: DataFrame,
    manifests: DataFrame,
    receipts: DataFrame,
    packages: DataFrame,
    key: str = "pack_id",
) -> DataFrame:
    """Do the artifacts of a pack name each other's heads? First broken link per pack.

    statements: ``stated_package, stated_bundle, stated_manifest, stated_receipt``;
    bundles: ``bundle_sha256, report_sha256``; manifests: ``manifest_sha256,
    policy_sha256, trust_mode``; receipts: ``receipt_sha256, receipt_bundle,
    receipt_report, receipt_manifest, receipt_policy, receipt_mode``; packages:
    ``package_sha256``.
    """
    c = F.col
    joined = statements
    for table in (bundles, manifests, receipts, packages):
        joined = joined.join(table, key, "left")
    links = [
        ("stated_package", "package_sha256", "STATEMENT_PACKAGE_MISMATCH"),
        ("stated_bundle", "bundle_sha256", "STATEMENT_BUNDLE_MISMATCH"),
        ("stated_manifest", "manifest_sha256", "STATEMENT_MANIFEST_MISMATCH"),
        ("stated_receipt", "receipt_sha256", "STATEMENT_RECEIPT_MISMATCH"),
        ("receipt_bundle", "bundle_sha256", "RECEIPT_BUNDLE_MISMATCH"),
        ("receipt_report", "report_sha256", "RECEIPT_REPORT_MISMATCH"),
        ("receipt_manifest", "manifest_sha256", "RECEIPT_MANIFEST_MISMATCH"),
        ("receipt_mode", "trust_mode", "RECEIPT_MODE_MISMATCH"),
        ("receipt_policy", "policy_sha256", "RECEIPT_POLICY_MISMATCH"),
    ]
    code = first_failure([(c(left) == c(right), name) for left, right, name in links])
    return joined.withColumn("failure_code", code)


def upgrade_binding_check(bindings: DataFrame, releases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Versions and manifests of two releases agree with the upgrade evidence.

    bindings: ``binding_id, previous_release, current_release, evidence_id``; releases:
    ``release_id, version, manifest_sha256``; evidence: ``evidence_id, previous_version,
    current_version, previous_manifest_sha256, current_manifest_sha256``. Ids and manifests
    are compared in half their length, as all of them move with every join.
    """
    c = F.col
    sides = ("previous", "current")
    manifests = [f"{side}_manifest_sha256" for side in sides]
    texts = (
        is_text(bindings, "previous_release", "current_release", "evidence_id")
        and is_text(releases, "release_id", "manifest_sha256")
        and is_text(evidence, "evidence_id", *manifests)
    )

    def lean(name: str) -> Column:
        return packed(c(name)) if texts else c(name)

    index = releases.select(lean("release_id").alias("_release"), "version", lean("manifest_sha256").alias("_manifest"))

    def release(side: str) -> DataFrame:
        return index.select(
            c("_release").alias(f"_{side}_release"),
            c("version").alias(f"_{side}_version"),
            c("_manifest").alias(f"_{side}_manifest"),
        )

    keyed = bindings.withColumns({f"_{name}": lean(name) for name in ("previous_release", "current_release", "evidence_id")})
    claims = evidence.withColumns({f"_{name}": lean(name) for name in ("evidence_id", *manifests)}).drop("evidence_id")
    joined = (
        keyed.join(release("previous"), "_previous_release", "left")
        .join(release("current"), "_current_release", "left")
        .join(claims, "_evidence_id", "left")
    )
    versions = holds(c("_previous_version") == c("previous_version")) & holds(
        c("_current_version") == c("current_version")
    )
    code = first_failure(
        [
            (c("previous_version").isNotNull(), "UPGRADE_BINDING_EVIDENCE_MISSING"),
            (versions, "UPGRADE_BINDING_VERSION_MISMATCH"),
            (
                semver_key(c("previous_version")) < semver_key(c("current_version")),
                "UPGRADE_BINDING_VERSION_ORDER",
            ),
            (
                (c("_previous_manifest") == c("_previous_manifest_sha256"))
                & (c("_current_manifest") == c("_current_manifest_sha256")),
                "UPGRADE_BINDING_MANIFEST_MISMATCH",
            ),
        ]
    )
    return joined.withColumn("failure_code", code).drop(
        "_evidence_id", *[f"_{side}_{part}" for side in sides for part in ("release", "version", "manifest", "manifest_sha256")]
    )


REVISIONS = ("gate", "recorder", "ledger")


def statement_members(
    revisions: Sequence[str] = REVISIONS, namespace: str = "Quotelock", package: str = "quotelock"
) -> dict:
    """Canonical members of a provenance statement row."""
    c = F.col
    return {
        "version": F.lit(1),
        "kind": F.lit(f"{namespace}ProvenanceStatement"),
        "package": {
            "name": F.lit(package),
            "version": c("package_version"),
            "packageSha256": c("package_sha256"),
        },
        "revisions": {
            name: {"commit": c(f"{name}_commit"), "clean": c(f"{name}_clean")} for name in revisions
        },
        "artifacts": {
            "eventCount": c("event_count"),
            "bundleSha256": c("bundle_sha256"),
            "manifestSha256": c("manifest_sha256"),
            "receiptSha256": c("receipt_sha256"),
        },
        "assurance": {"signature": c("assurance"), "timestamp": F.lit("not-attested")},
    }


def statement_assurance(
    statements: DataFrame, revisions: Sequence[str] = REVISIONS, namespace: str = "Quotelock"
) -> DataFrame:
    """Provenance statements: clean revisions, own digest, and honest signature claims.

    A signed statement needs its signature, an unsigned one must not carry one, and
    where a key is expected (``expected_key_id``) an unsigned statement is a downgrade.
    """
    c = F.col
    signed = c("assurance") == "ed25519"
    rules = [
        (is_semver(c("package_version")) & is_digest(c("package_sha256")), "STATEMENT_SCHEMA_INVALID"),
        *[
            (is_commit(c(f"{name}_commit")) & c(f"{name}_clean"), "STATEMENT_REVISION_INVALID")
            for name in revisions
        ],
        (
            (c("event_count") == 4)
            & is_digest(c("bundle_sha256"))
            & is_digest(c("manifest_sha256"))
            & is_digest(c("receipt_sha256")),
            "STATEMENT_ARTIFACTS_INVALID",
        ),
        (c("assurance").isin("none", "ed25519"), "STATEMENT_ASSURANCE_INVALID"),
        (
            canonical_digest(statement_members(revisions, namespace)) == c("statement_sha256"),
            "STATEMENT_INTEGRITY_INVALID",
        ),
        (~signed | c("signature_key_id").isNotNull(), "STATEMENT_SIGNATURE_MISSING"),
        (signed | c("signature_key_id").isNull(), "STATEMENT_SIGNATURE_UNEXPECTED"),
        (signed | c("expected_key_id").isNull(), "STATEMENT_SIGNATURE_DOWNGRADE"),
        (~signed | c("expected_key_id").isNotNull(), "STATEMENT_KEY_REQUIRED"),
        (~signed | c("signature_key_id").eqNullSafe(c("expected_key_id")), "STATEMENT_KEY_MISMATCH"),
        (~signed | c("signature_valid"), "STATEMENT_SIGNATURE_INVALID"),
    ]
    return statements.withColumn("failure_code", first_failure(rules))


def sample_median(
    samples: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Median of each measure per checkpoint."""
    return samples.groupBy(*keys).agg(*[F.median(name).alias(name) for name in values])


def _ratio(candidate: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.when(candidate == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))).otherwise(
        F.round(candidate / baseline, 4)
    )


def regression_checkpoints(
    baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], max_ratio: float = 1.25
) -> DataFrame:
    """Append and verification ratios per checkpoint.

    Both sides have the key columns, ``packet_count``, ``lineage_bytes``, ``append_ms`` and
    ``verify_ms``. A checkpoint missing on one side, or of another size, has a code.
    """
    on = [*keys, "packet_count"]
    measures = ("lineage_bytes", "append_ms", "verify_ms")
    left = baseline.select(*on, *[F.col(name).alias(f"old_{name}") for name in measures])
    right = candidate.select(*on, *[F.col(name).alias(f"new_{name}") for name in measures])
    sides = left.join(right, on, "left")
    alone = right.join(left.select(*on), on, "left_anti")
    joined = sides.unionByName(alone, allowMissingColumns=True)
    append = _ratio(F.col("new_append_ms"), F.col("old_append_ms"))
    verify = _ratio(F.col("new_verify_ms"), F.col("old_verify_ms"))
    return joined.select(
        *on,
        append.alias("append_ratio"),
        verify.alias("verification_ratio"),
        holds((append <= max_ratio) & (verify <= max_ratio)).alias("within_limit"),
        first_failure(
            [
                (
                    F.col("new_lineage_bytes").isNotNull() & F.col("old_lineage_bytes").isNotNull(),
                    "BENCHMARK_CHECKPOINT_MISSING",
                ),
                (
                    F.col("new_lineage_bytes") == F.col("old_lineage_bytes"),
                    "BENCHMARK_SIZE_CHANGED",
                ),
            ]
        ).alias("failure_code"),
    )


def regression_verdict(checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regressed when the last checkpoint, or two of them, exceed the ratio."""
    exceeded = ~F.col("within_limit")
    totals = checkpoints.groupBy(*keys).agg(
        F.count("*").alias("checkpoints"),
        F.count_if(exceeded).alias("exceeded"),
        F.max_by("within_limit", "packet_count").alias("_last"),
        F.coalesce(
            F.min_by("failure_code", F.when(F.col("failure_code").isNotNull(), F.col("packet_count"))),
            F.min("failure_code"),
        ).alias("failure_code"),
    )
    regressed = (F.col("exceeded") >= 2) | ~F.col("_last")
    return totals.withColumn(
        "outcome",
        F.when(F.col("failure_code").isNotNull(), "invalid")
        .when(regressed, "regressed")
        .otherwise("verified"),
    ).drop("_last")
