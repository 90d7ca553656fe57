"""Review: status per candidate, latest attempts, provenance and linkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelock.functions.digests import is_digest
from quotelock.functions.ladder import first_failure, holds
from quotelock.functions.text import bounded_display, nul_safe

SUMMARY_CHARS = 240


def first_per_key(
    rows: DataFrame, key: str, order: Column, limit: int | None, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of every key, or all of them, ranked.

    The filter on the row number lets Spark keep only ``limit`` rows per key before
    the shuffle, so a key with very many rows does not fill one task.
    """
    window = Window.partitionBy(key).orderBy(order)
    ranked = rows.withColumn(rank, F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The last attempt of each candidate, by a grouped maximum."""
    others = [name for name in attempts.columns if name != "candidate_id"]
    return (
        attempts.groupBy("candidate_id")
        .agg(F.max_by(F.struct(*others), "sequence").alias("_last"))
        .select("candidate_id", "_last.*")
    )


def attempt_list(attempts: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` attempts of each candidate, or all."""
    newest = F.col("sequence").desc()
    return first_per_key(attempts, "candidate_id", newest, limit)


def review_summaries(candidates: DataFrame, limit: int = SUMMARY_CHARS) -> DataFrame:
    """Narrow projection for lists: no quote longer than ``limit``, no content."""
    quote = nul_safe(F.col("exact"))
    return candidates.select(
        "candidate_id",
        bounded_display(quote, limit).alias("quote"),
        ((F.char_length(quote) > limit) | (quote != F.col("exact"))).alias("quote_truncated"),
        nul_safe(F.col("prefix")).alias("prefix"),
        nul_safe(F.col("suffix")).alias("suffix"),
        "observed_at",
        "available_at",
        "captured_at",
        "sha256",
        "byte_length",
        nul_safe(F.col("media_type")).alias("media_type"),
        nul_safe(F.col("source_uri")).alias("source_uri"),
        "persisted_at",
    )


def _with_review(
    base: DataFrame, evidence: DataFrame, promotions: DataFrame, attempts: DataFrame, listed: bool
) -> DataFrame:
    last = latest_attempt(attempts).select(
        "candidate_id",
        F.col("sequence").alias("attempt_sequence"),
        F.col("outcome").alias("attempt_outcome"),
        "failure_code",
    )
    verified = evidence.select("candidate_id", "evidence_id")
    promoted = promotions.select(
        "candidate_id",
        F.col("evidence_id").alias("promotion_evidence_id"),
        F.col("sequence").alias("promotion_sequence"),
    )
    joined = (
        base.join(verified, "candidate_id", "left")
        .join(promoted, "candidate_id", "left")
        .join(last, "candidate_id", "left")
    )
    is_verified = (
        holds(F.col("promotion_evidence_id") == F.col("evidence_id"))
        if listed
        else F.col("evidence_id").isNotNull()
    )
    status = (
        F.when(is_verified, "verified")
        .when(holds(F.col("attempt_outcome") == "rejected"), "rejected")
        .otherwise("candidate")
    )
    return joined.withColumn("status", status)


def review_items(
    candidates: DataFrame, evidence: DataFrame, promotions: DataFrame, attempts: DataFrame
) -> DataFrame:
    """Detail rows. A candidate is verified when it has evidence."""
    return _with_review(candidates, evidence, promotions, attempts, listed=False)


def review_list(
    summaries: DataFrame,
    evidence: DataFrame,
    promotions: DataFrame,
    attempts: DataFrame,
    limit: int,
) -> DataFrame:
    """The newest ``limit`` summaries with their status.

    A listed candidate is verified when a promotion names its evidence. The limit is
    taken before the joins, and its ids prune the three other tables.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    newest = [F.col("persisted_at").desc(), F.col("candidate_id")]
    top = summaries.orderBy(*newest).limit(limit)
    ids = top.select("candidate_id")
    pruned = [table.join(ids, "candidate_id", "left_semi") for table in (evidence, promotions, attempts)]
    return _with_review(top, *pruned, listed=True).orderBy(*newest)


def status_totals(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Counts per status and whether a list of ``limit`` rows was cut."""
    status = F.col("status")
    return items.agg(
        F.count("*").alias("all_items"),
        F.count_if(status == "candidate").alias("candidate"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status == "verified").alias("verified"),
        (F.lit(False) if limit is None else F.count("*") == limit).alias("limited"),
    )


def evidence_binding(
    evidence: DataFrame, candidates: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Evidence must equal its candidate in the given columns, NULLs included."""
    claimed = candidates.select(
        "candidate_id", F.struct(*columns).alias("_candidate"), F.lit(True).alias("_known")
    )
    equal = F.col("_known")
    for name in columns:
        equal = equal & F.col(name).eqNullSafe(F.col("_candidate")[name])
    return (
        evidence.join(claimed, "candidate_id", "left")
        .withColumn("failure_code", first_failure([(equal, "INVALID_EVIDENCE_ENVELOPE")]))
        .drop("_candidate", "_known")
    )


def capture_linkage(
    candidates: DataFrame, captures: DataFrame, digest: str = "snapshot_digest"
) -> DataFrame:
    """Web candidates and their retained capture, by snapshot reference.

    No capture, more than one, or one whose snapshot differs is a code. Local sources
    need none.
    """
    linked = captures.groupBy("snapshot_ref").agg(
        F.count("*").alias("capture_count"),
        F.min_by(F.struct("capture_id", F.col(digest).alias("digest")), "capture_id").alias("_capture"),
    )
    code = F.when(F.col("source_kind") == "local", F.lit(None).cast("string")).otherwise(
        first_failure(
            [
                (F.col("capture_count") >= 1, "CAPTURE_MISSING"),
                (F.col("capture_count") == 1, "CAPTURE_AMBIGUOUS"),
                (F.col("_capture")["digest"] == F.col(digest), "CAPTURE_MISMATCH"),
            ]
        )
    )
    joined = candidates.join(linked, "snapshot_ref", "left").withColumn("failure_code", code)
    return joined.withColumn(
        "capture_id",
        F.when(
            F.col("failure_code").isNull() & (F.col("source_kind") == "web"), F.col("_capture")["capture_id"]
        ),
    ).withColumn("capture_count", F.coalesce("capture_count", F.lit(0))).drop("_capture")


def immutable_merge(store: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Insert or verify: each incoming record is new, identical or in conflict.

    Without a key or a digest nothing can be verified, so such records are in conflict, and
    so are different records that come in under one new key.
    """
    kept = store.groupBy(key).agg(
        F.min(digest).alias("_stored"), F.max(digest).alias("_stored_other"), F.count("*").alias("_rows"),
        F.count(digest).alias("_digests"),
    )
    among = incoming.groupBy(key).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"))
    known = F.col("_rows").isNotNull()
    stored_whole = (F.col("_digests") == F.col("_rows")) & (F.col("_stored") == F.col("_stored_other"))
    merge = (
        F.when(F.col(key).isNull() | F.col(digest).isNull(), "conflict")
        .when(known & stored_whole & (F.col("_stored") == F.col(digest)), "identical")
        .when(~known & (F.col("_low") == F.col("_high")), "new")
        .otherwise("conflict")
    )
    return (
        incoming.join(kept, key, "left")
        .join(among, key, "left")
        .withColumn("merge", merge)
        .drop("_stored", "_stored_other", "_rows", "_digests", "_low", "_high")
    )


def review_context(items: DataFrame, snapshots: DataFrame, size: int = 280) -> DataFrame:
    """The text around each quote, shown only when the stored bytes are intact."""
    from quotelock.functions.text import context_after, context_before
    from quotelock.sources.snapshots import snapshot_facts

    joined = items.join(snapshot_facts(snapshots), "snapshot_ref", "left").withColumn(
        "_start", F.position(F.col("exact"), F.col("text"))
    )
    intact = holds(
        (F.col("actual_sha256") == F.col("sha256"))
        & (F.col("actual_length") == F.col("byte_length"))
        & is_digest(F.col("sha256"))
        & (F.col("_start") > 0)
    )
    before = context_before(F.col("text"), F.col("_start"), size)
    after = context_after(F.col("text"), F.col("_start"), F.char_length("exact"), size)
    return joined.withColumns(
        {
            "integrity": F.when(intact, "verified").otherwise("failed"),
            "before": F.when(intact, before),
            "after": F.when(intact, after),
        }
    ).drop("text", "actual_sha256", "actual_length", "_start")


def run_diff(
    reports: DataFrame, group: Sequence[str], order: str, block: Column, revisions: Mapping[str, str]
) -> DataFrame:
    """Each run's revisions against the run before it; repeated heads are rejected.

    ``revisions`` maps an output name to the revision column it compares.
    """
    from quotelock.plans.blocks import carry_forward, join_with_nulls

    seen = reports.groupBy(*group, "head_sha256").agg(F.count("*").alias("_copies"))
    staged = join_with_nulls(reports, seen, [*group, "head_sha256"])
    paired = carry_forward(
        staged,
        group,
        [order, "head_sha256"],
        block,
        F.struct(*revisions.values()),
        "_previous",
        strict=True,
    )
    changes = {
        name: F.when(
            F.col("_previous").isNotNull(), ~F.col(column).eqNullSafe(F.col("_previous")[column])
        )
        for name, column in revisions.items()
    }
    return (
        paired.withColumns(changes)
        .withColumn(
            "failure_code",
            first_failure(
                [
                    (F.col("head_sha256").isNotNull() & F.col(order).isNotNull(), "REPORT_INVALID"),
                    (F.col("_copies") == 1, "REPORT_HEAD_DUPLICATE"),
                ]
            ),
        )
        .drop("_previous", "_copies")
    )
