"""Trust policies, signatures and quorums. Signature checks arrive as a flag column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelock.functions.digests import Optional, canonical_digest, is_digest
from quotelock.functions.instants import instant_key, is_canonical_instant
from quotelock.functions.ladder import first_failure, holds, whole_number
from quotelock.functions.records import is_canonical_order, set_delta
from quotelock.plans.blocks import BLOCK_SECONDS, carry_forward, join_with_nulls, with_previous



def _key_list(keys: Column, max_keys: int | None) -> Column:
    return whole_number(F.size(keys), 1, max_keys) & holds(F.forall(keys, is_digest))


def trust_policy_validate(policies: DataFrame, max_keys: int | None = None) -> DataFrame:
    """Manual policies: key lists, threshold and validity window."""
    c = F.col
    trusted, revoked = c("trusted_key_ids"), c("revoked_key_ids")
    since, until = c("valid_from"), c("valid_until")
    rules = [
        (_key_list(trusted, max_keys), "POLICY_KEYS_INVALID"),
        (F.size(F.array_distinct(trusted)) == F.size(trusted), "POLICY_KEY_DUPLICATE"),
        (is_canonical_order(trusted), "POLICY_KEYS_UNSORTED"),
        (c("threshold").between(1, F.size(trusted)), "POLICY_THRESHOLD_INVALID"),
        (
            revoked.isNull() | (_key_list(revoked, max_keys) & is_canonical_order(revoked)),
            "POLICY_REVOKED_INVALID",
        ),
        (revoked.isNull() | ~F.arrays_overlap(trusted, revoked), "POLICY_KEY_REVOKED"),
        (since.isNull() | is_canonical_instant(since), "POLICY_TIME_INVALID"),
        (until.isNull() | is_canonical_instant(until), "POLICY_TIME_INVALID"),
        (
            since.isNull() | until.isNull() | (instant_key(since) < instant_key(until)),
            "POLICY_WINDOW_INVALID",
        ),
    ]
    return policies.withColumn("failure_code", first_failure(rules))


def manual_policy_digest() -> Column:
    """Digest a receipt keeps of the manual policy it was made under."""
    c = F.col
    revoked = F.coalesce(c("revoked_key_ids"), F.array().cast("array<string>"))
    return canonical_digest(
        {
            "threshold": c("threshold"),
            "trustedKeyIds": F.array_sort("trusted_key_ids"),
            "revokedKeyIds": F.array_sort(revoked),
            "validFrom": Optional(c("valid_from")),
            "validUntil": Optional(c("valid_until")),
        }
    )


def active_policy_asof(
    policies: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    policy_time: str,
    probe_time: str,
    value: Sequence[str],
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """For each probe the latest policy in force, else POLICY_NOT_YET_ACTIVE.

    Times are integer columns (epoch seconds). ``value`` names the policy columns to
    return; the first of them must be the policy's ``sequence``, from 1 without gaps or
    repeats, else the key's probes are POLICY_SEQUENCE_INVALID. Policies and probes are
    laid on one time line per key and carried forward block by block, so a key with
    many policies or probes is spread over tasks.
    """
    extra = [name for name in probes.columns if name not in (*keys, probe_time)]
    payload = F.struct(*value)
    policy_rows = policies.select(
        *keys,
        F.col(policy_time).alias("_time"),
        F.lit(0).alias("_probe"),
        F.col(value[0]).cast("bigint").alias("_tie"),
        payload.alias("_policy"),
        F.lit(None).cast(probes.select(F.struct(*extra, probe_time).alias("p")).schema["p"].dataType).alias("_row"),
    )
    probe_rows = probes.select(
        *keys,
        F.col(probe_time).alias("_time"),
        F.lit(1).alias("_probe"),
        F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).cast(policies.select(payload.alias("p")).schema["p"].dataType).alias("_policy"),
        F.struct(*extra, probe_time).alias("_row"),
    )
    line = carry_forward(
        policy_rows.unionByName(probe_rows),
        keys,
        ["_time", "_probe", "_tie"],
        F.floor(F.col("_time") / block_seconds),
        F.col("_policy"),
        "_active",
    )
    sequence = F.col(value[0])
    totals = (
        policies.groupBy(*keys, sequence.alias("_sequence"))
        .agg(F.count("*").alias("_copies"))
        .groupBy(*keys)
        .agg(
            F.sum("_copies").alias("_policies"),
            ((F.min("_sequence") == 1) & (F.max("_sequence") == F.sum("_copies")) & (F.count("_sequence") == F.sum("_copies"))).alias("_numbered"),
        )
    )
    answered = join_with_nulls(line.where(F.col("_probe") == 1), totals, list(keys))
    active = F.col("_active")
    numbered = F.col("_policies").isNull() | holds(F.col("_numbered"))
    return answered.select(
        *keys,
        "_row.*",
        *[active[name].alias(name) for name in value],
        F.when(numbered, F.coalesce("_policies", F.lit(0)) - F.coalesce(active[value[0]], F.lit(0)))
        .cast("bigint")
        .alias("scheduled_count"),
        F.when(~numbered, "POLICY_SEQUENCE_INVALID")
        .when(F.col("_time").isNull() | active.isNull(), "POLICY_NOT_YET_ACTIVE")
        .alias("failure_code"),
    )


def signature_filter(
    signatures: DataFrame,
    reports: DataFrame,
    trusted: DataFrame,
    revoked: DataFrame,
    order: str = "signature_order",
) -> DataFrame:
    """Code per signature, and whether it counts towards the quorum.

    ``signatures``: ``(report_id, key_id, report_sha256, signature_valid, order)``;
    ``reports``: ``(report_id, expected_sha256)``; ``trusted`` and ``revoked``: ``(key_id)``.
    A valid signature of an untrusted key is no error, it only does not count. Of a trusted
    signer only the first signature passes; when two share that place, none does.

    The rows are wide, so they move once, by report: the places of a signer are told apart
    and the report is joined in that order. Signatures without a report stay where they are.
    """
    flags = (
        trusted.select("key_id", F.lit(True).alias("_trusted"))
        .unionByName(revoked.select("key_id", F.lit(False).alias("_trusted")))
        .groupBy("key_id")
        .agg(F.bool_or("_trusted").alias("_trusted"), F.bool_or(~F.col("_trusted")).alias("_revoked"))
    )
    places = Window.partitionBy("report_id", "key_id").orderBy(order)
    joined = (
        signatures.where(F.col("report_id").isNotNull())
        .join(flags, "key_id", "left")
        .repartition("report_id")
        .withColumns(
            {
                "_place": F.rank().over(places),
                "_copies": F.count("*").over(places.rangeBetween(Window.currentRow, Window.currentRow)),
            }
        )
        .join(reports, "report_id", "left")
    )
    is_trusted = holds(F.col("_trusted"))
    alone = F.col(order).isNotNull() & (F.col("_place") == 1) & (F.col("_copies") == 1)
    code = first_failure(
        [
            (F.col("report_sha256") == F.col("expected_sha256"), "SIGNATURE_REPORT_MISMATCH"),
            (~holds(F.col("_revoked")), "SIGNATURE_KEY_REVOKED"),
            (~is_trusted | alone, "SIGNATURE_SIGNER_DUPLICATE"),
            (F.col("signature_valid"), "SIGNATURE_INVALID"),
        ]
    )
    unplaced = signatures.where(F.col("report_id").isNull()).withColumns(
        {"failure_code": F.lit("SIGNATURE_REPORT_MISMATCH"), "counted": F.lit(False)}
    )
    return (
        joined.withColumn("failure_code", code)
        .withColumn("counted", F.col("failure_code").isNull() & is_trusted)
        .drop("_place", "_copies", "_trusted", "_revoked", "expected_sha256")
        .unionByName(unplaced, allowMissingColumns=True)
    )


def signer_quorum(
    filtered: DataFrame,
    policies: DataFrame,
    verified_at: Column,
    strict: bool = True,
    order: str = "signature_order",
) -> DataFrame:
    """Distinct counted signers against the threshold, inside the validity window.

    ``policies`` has one row per report: ``(report_id, threshold, trusted_count,
    valid_from, valid_until)``. With ``strict`` any bad signature rejects its report.
    """
    bad = F.when(F.col("failure_code").isNotNull(), F.col(order))
    signers = filtered.groupBy("report_id").agg(
        F.count_distinct(F.when(F.col("counted"), F.col("key_id"))).alias("verified_signers"),
        F.coalesce(F.min_by("failure_code", bad), F.min("failure_code")).alias("_signature_code"),
    )
    at = instant_key(verified_at)
    since, until = F.col("valid_from"), F.col("valid_until")
    rules = [
        (F.col("threshold") >= 1, "POLICY_THRESHOLD_INVALID"),
        (since.isNull() | (at >= instant_key(since)), "POLICY_NOT_YET_VALID"),
        (until.isNull() | (at < instant_key(until)), "POLICY_EXPIRED"),
        (F.col("threshold") <= F.col("trusted_count"), "POLICY_THRESHOLD_UNREACHABLE"),
    ]
    if strict:
        rules.append((F.col("_signature_code").isNull(), F.col("_signature_code")))
    rules.append((F.col("verified_signers") >= F.col("threshold"), "SIGNATURE_THRESHOLD_NOT_MET"))
    return (
        policies.join(signers, "report_id", "left")
        .withColumn("verified_signers", F.coalesce("verified_signers", F.lit(0)))
        .withColumn("failure_code", first_failure(rules))
        .drop("_signature_code")
    )


def rotation_summary(
    entries: DataFrame, history: Sequence[str], verified_at: Column, time: Column | None = None
) -> DataFrame:
    """Active policy of every rotation history at a time, and its key changes.

    ``entries``: history columns, ``sequence``, ``effective_at`` (instant text) and
    ``key_ids``. ``time`` overrides how ``effective_at`` is ordered.
    """
    effective = instant_key(F.col("effective_at")) if time is None else time
    at = instant_key(verified_at) if time is None else verified_at
    paired = with_previous(entries, history, "sequence", {"key_ids": F.col("key_ids")})
    added, removed = set_delta(F.col("previous")["key_ids"], F.col("key_ids"))
    staged = paired.withColumns(
        {
            "_active": holds(effective <= at),
            "_added": F.when(F.col("previous").isNull(), 0).otherwise(added),
            "_removed": F.when(F.col("previous").isNull(), 0).otherwise(removed),
        }
    )
    active = F.when(F.col("_active"), F.col("sequence"))
    summary = staged.groupBy(*history).agg(
        F.count("*").alias("entry_count"),
        F.max_by(F.struct("sequence", "effective_at", "_added", "_removed"), active).alias("_last"),
    )
    last = F.col("_last")
    return summary.select(
        *history,
        "entry_count",
        last["sequence"].cast("bigint").alias("active_sequence"),
        (last["sequence"] - 1).cast("bigint").alias("completed_rotations"),
        (F.col("entry_count") - last["sequence"]).cast("bigint").alias("scheduled_count"),
        last["effective_at"].alias("latest_effective_at"),
        last["_added"].cast("bigint").alias("latest_added_key_count"),
        last["_removed"].cast("bigint").alias("latest_removed_key_count"),
        F.when(last.isNull(), "POLICY_NOT_YET_ACTIVE").alias("failure_code"),
    )


def rotation_validate(
    entries: DataFrame, history: Sequence[str], anchors: DataFrame
) -> DataFrame:
    """Rotation entries: order, anchors and the quorum of the preceding policy.

    ``entries`` adds ``threshold`` and ``signers`` (array of the keys whose signature is
    valid) to the columns of :func:`rotation_summary`; ``anchors`` has the history columns,
    ``anchor_key_ids`` and ``anchor_threshold``.
    """
    staged = entries.withColumn("_at", instant_key(F.col("effective_at")))
    paired = with_previous(
        staged,
        history,
        "sequence",
        {"key_ids": F.col("key_ids"), "threshold": F.col("threshold"), "at": F.col("_at")},
    ).join(anchors, list(history), "left")
    previous = F.col("previous")
    first = F.col("sequence") == 1
    keys = F.when(first, F.col("key_ids")).otherwise(previous["key_ids"])
    needed = F.when(first, F.col("threshold")).otherwise(previous["threshold"])
    rules = [
        (first | previous.isNotNull(), "ROTATION_SEQUENCE_GAP"),
        (is_canonical_instant(F.col("effective_at")), "ROTATION_TIME_INVALID"),
        (first | (previous["at"] < F.col("_at")), "ROTATION_TIME_NOT_INCREASING"),
        (
            is_canonical_order(F.col("key_ids"))
            & F.col("threshold").between(1, F.size("key_ids")),
            "ROTATION_POLICY_INVALID",
        ),
        (
            ~first
            | (
                (F.col("key_ids") == F.col("anchor_key_ids"))
                & (F.col("threshold") == F.col("anchor_threshold"))
            ),
            "ROTATION_ANCHOR_MISMATCH",
        ),
        (F.size(F.array_except("signers", keys)) == 0, "ROTATION_SIGNER_UNAUTHORIZED"),
        (F.size(F.array_distinct("signers")) == F.size("signers"), "ROTATION_SIGNER_DUPLICATE"),
        (F.size("signers") >= needed, "ROTATION_QUORUM_NOT_MET"),
    ]
    return paired.withColumn("failure_code", first_failure(rules)).drop(
        "_at", "previous", "anchor_key_ids", "anchor_threshold"
    )


def review_receipt(requests: DataFrame) -> DataFrame:
    """Verification receipts from quorum results and the policy they were made under.

    ``requests`` joins a report (``report_sha256``, ``bundle_sha256``,
    ``report_protected``), its quorum (``verified_signers``, ``threshold``,
    ``quorum_code``) and the policy settings: ``trusted_key_ids`` with the manual
    columns, or ``history_sha256`` with ``active_sequence``. Manual and rotation settings
    exclude each other.
    """
    c = F.col
    manual, rotation = c("trusted_key_ids").isNotNull(), c("history_sha256").isNotNull()
    code = first_failure(
        [
            (c("report_protected"), "REPORT_UNPROTECTED"),
            (~(manual & rotation), "TRUST_SETTINGS_MIXED"),
            (manual | rotation, "TRUST_SETTINGS_MISSING"),
            (~rotation | (is_digest(c("history_sha256")) & c("active_sequence").isNotNull()), "TRUST_ROTATION_INCOMPLETE"),
            (c("quorum_code").isNull(), c("quorum_code")),
        ]
    )
    policy = F.when(manual, manual_policy_digest())
    staged = requests.withColumn("failure_code", code)
    valid = c("failure_code").isNull()
    staged = staged.withColumns(
        {
            "trust_mode": F.when(valid, F.when(manual, "manual").otherwise("rotation-history")),
            "policy_sha256": F.when(valid, policy),
        }
    )
    receipt = canonical_digest(
        {
            "version": F.lit(1),
            "outcome": F.lit("verified"),
            "verifiedAt": c("verified_at"),
            "bundle": {"version": F.lit(1), "bundleSha256": c("bundle_sha256")},
            "report": {"reportSha256": c("report_sha256")},
            "signatures": {
                "algorithm": F.lit("ed25519"),
                "verifiedSignerCount": c("verified_signers"),
                "threshold": c("threshold"),
            },
            "trust": {
                "mode": c("trust_mode"),
                "policySha256": Optional(c("policy_sha256")),
                "historySha256": Optional(c("history_sha256")),
                "activeSequence": Optional(c("active_sequence")),
            },
        }
    )
    return staged.withColumn("receipt_sha256", F.when(valid, receipt))
