"""The promotion gate: envelope rules, snapshot integrity and selector checks.

Each operator keeps every row and adds ``failure_code``; NULL means that all rules
hold. Candidates are flat tables with the columns of :data:`CANDIDATE_FIELDS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import is_digest
from quotelock.functions.instants import instant_key
from quotelock.functions.ladder import (
    at_most,
    Rule,
    bounded_bytes,
    bounded_chars,
    first_failure,
    holds,
    whole_number,
)
from quotelock.functions.text import (
    SELECTOR_CONTEXT,
    context_after,
    context_before,
    is_html,
)
from quotelock.operators.html_view import TRANSFORMATION
from quotelock.sources.snapshots import TEXT_MEDIA_TYPE, snapshot_facts

CANDIDATE_KIND = "EvidenceCandidate"
EVIDENCE_KIND = "VerifiedEvidence"
VIEW_KIND = "DerivedCitationView"
SELECTOR_TYPE = "TextQuoteSelector"

CANDIDATE_FIELDS = (
    "candidate_id",
    "kind",
    "snapshot_ref",
    "media_type",
    "sha256",
    "byte_length",
    "object_path",
    "source_uri",
    "captured_at",
    "available_at",
    "selector_type",
    "exact",
    "prefix",
    "suffix",
    "citation_view",
    "observed_at",
)
VIEW_TYPE = (
    "struct<kind:string,transformation:string,source_sha256:string,"
    "media_type:string,sha256:string,byte_length:bigint>"
)


def with_instant_keys(rows: DataFrame, *names: str) -> DataFrame:
    """Add ``_<name>_key`` once per instant column, for use in several rules."""
    return rows.withColumns(
        {
            f"_{name}_key": F.when(F.char_length(name) <= 64, instant_key(F.col(name)))
            for name in names
        }
    )


def _key(name: str) -> Column:
    return F.col(f"_{name}_key")


def view_shape(view: Column, media_type: Column, sha256: Column, transformation: str = TRANSFORMATION) -> Column:
    """A citation view is well formed and bound to this HTML source."""
    return holds(
        is_html(media_type)
        & (view["kind"] == VIEW_KIND)
        & (view["transformation"] == transformation)
        & (view["media_type"] == TEXT_MEDIA_TYPE)
        & (view["source_sha256"] == sha256)
        & is_digest(view["sha256"])
        & whole_number(view["byte_length"], 0, None)
    )


def _envelope_rules(
    kind: str,
    max_bytes: int | None,
    transformation: str = TRANSFORMATION,
    max_quote_bytes: int | None = None,
) -> list[Rule]:
    c = F.col
    invalid, instant = "INVALID_EVIDENCE_ENVELOPE", "INVALID_TIMESTAMP"
    evidence = kind == EVIDENCE_KIND
    identifiers = ["evidence_id", "candidate_id"] if evidence else ["candidate_id"]
    instants = ["available_at", "captured_at", "observed_at"] + (["verified_at"] if evidence else [])
    ordered = F.lit(True)
    for earlier, later in zip(instants, instants[1:]):
        ordered = ordered & holds(_key(earlier) <= _key(later))
    view_needed = c("citation_view").isNotNull() | is_html(c("media_type"))
    return [
        (c("kind") == kind, invalid),
        *[(bounded_bytes(c(name), 256), invalid) for name in identifiers],
        (bounded_chars(c("media_type"), 256), invalid),
        (is_digest(c("sha256")), invalid),
        (whole_number(c("byte_length"), 0, max_bytes), invalid),
        (bounded_chars(c("object_path"), 4096), invalid),
        (bounded_chars(c("source_uri"), 4096), invalid),
        (_key("captured_at").isNotNull(), instant),
        (_key("available_at").isNotNull(), instant),
        (c("selector_type") == SELECTOR_TYPE, invalid),
        (bounded_bytes(c("exact"), max_quote_bytes), invalid),
        (bounded_chars(c("prefix"), SELECTOR_CONTEXT, empty=True), invalid),
        (bounded_chars(c("suffix"), SELECTOR_CONTEXT, empty=True), invalid),
        (_key("observed_at").isNotNull(), instant),
        *([(_key("verified_at").isNotNull(), instant)] if evidence else []),
        (ordered, "TIMESTAMP_ORDER_INVALID"),
        (
            ~view_needed | view_shape(c("citation_view"), c("media_type"), c("sha256"), transformation),
            "CITATION_VIEW_INVALID",
        ),
    ]


def _drop_working(rows: DataFrame) -> DataFrame:
    return rows.drop(*[name for name in rows.columns if name.startswith("_")])


def envelope_validate(
    records: DataFrame,
    kind: str = CANDIDATE_KIND,
    max_bytes: int | None = None,
    transformation: str = TRANSFORMATION,
    max_quote_bytes: int | None = None,
) -> DataFrame:
    """Check candidate or evidence records field by field; adds ``failure_code``.

    ``transformation`` is the name that stored citation views were made under.
    """
    instants = ["available_at", "captured_at", "observed_at"]
    if kind == EVIDENCE_KIND:
        instants.append("verified_at")
    staged = with_instant_keys(records, *instants)
    return _drop_working(
        staged.withColumn("failure_code", first_failure(_envelope_rules(kind, max_bytes, transformation, max_quote_bytes)))
    )


def timestamp_order(records: DataFrame) -> DataFrame:
    """``available <= captured <= observed <= verified``, to the nanosecond."""
    names = ["available_at", "captured_at", "observed_at", "verified_at"]
    staged = with_instant_keys(records, *names)
    known = [(_key(name).isNotNull(), "INVALID_TIMESTAMP") for name in names[:3]]
    rules = [
        *known,
        (
            (_key("available_at") <= _key("captured_at"))
            & (_key("captured_at") <= _key("observed_at")),
            "TIMESTAMP_ORDER_INVALID",
        ),
        (_key("observed_at") <= _key("verified_at"), "VERIFICATION_TIME_INVALID"),
    ]
    return _drop_working(staged.withColumn("failure_code", first_failure(rules)))


def _integrity_rules(max_bytes: int | None) -> list[Rule]:
    # Size is tested before the digest.
    return [
        (F.col("actual_length").isNotNull(), "SNAPSHOT_MISSING"),
        (at_most(F.col("actual_length"), max_bytes), "SNAPSHOT_TOO_LARGE"),
        (F.col("actual_length") == F.col("byte_length"), "SNAPSHOT_SIZE_MISMATCH"),
        (F.col("actual_sha256") == F.col("sha256"), "SNAPSHOT_HASH_MISMATCH"),
    ]


def snapshot_integrity(
    records: DataFrame, snapshots: DataFrame, max_bytes: int | None = None
) -> DataFrame:
    """Compare the claimed size and digest with the stored bytes."""
    facts = snapshot_facts(snapshots, max_bytes).drop("text")
    joined = records.join(facts, "snapshot_ref", "left")
    return joined.withColumn("failure_code", first_failure(_integrity_rules(max_bytes))).drop(
        "actual_length", "actual_sha256"
    )


def _selector_rules(text: Column, start: Column) -> list[Rule]:
    exact = F.col("exact")
    return [
        ((F.char_length(exact) > 0) & (start > 0), "SELECTOR_NOT_FOUND"),
        (F.position(exact, text, start + 1) == 0, "SELECTOR_AMBIGUOUS"),
        (
            (context_before(text, start, SELECTOR_CONTEXT) == F.col("prefix"))
            & (
                context_after(text, start, F.char_length(exact), SELECTOR_CONTEXT)
                == F.col("suffix")
            ),
            "SELECTOR_CONTEXT_MISMATCH",
        ),
    ]


def selector_check(rows: DataFrame, text: str = "text") -> DataFrame:
    """The quote occurs exactly once, between its prefix and suffix.

    Two searches answer it: the first offset, and whether there is a later one.
    """
    start = F.position(F.col("exact"), F.col(text))
    staged = rows.withColumn("_start", start)
    return _drop_working(
        staged.withColumn("failure_code", first_failure(_selector_rules(F.col(text), F.col("_start"))))
    )


def promotion_gate(
    candidates: DataFrame,
    snapshots: DataFrame,
    views: DataFrame | None = None,
    verified_at: Column | None = None,
    max_bytes: int | None = None,
    transformation: str = TRANSFORMATION,
    max_quote_bytes: int | None = None,
) -> DataFrame:
    """Decide every candidate: ``outcome`` verified or rejected, with the first code.

    ``snapshots`` has ``(snapshot_ref, content)``. Digest and size of a content are
    taken once per snapshot, before the join. ``views`` (from ``html_text_views``) is
    needed when there are HTML candidates; without it they are rejected.
    ``verified_at`` defaults to the column of that name.
    """
    staged = candidates if verified_at is None else candidates.withColumn("verified_at", verified_at)
    staged = with_instant_keys(
        staged, "available_at", "captured_at", "observed_at", "verified_at"
    )
    joined = staged.join(snapshot_facts(snapshots, max_bytes), "snapshot_ref", "left")
    html = is_html(F.col("media_type"))
    if views is None:
        joined = joined.withColumns(
            {
                "view_text": F.lit(None).cast("string"),
                "view_sha256": F.lit(None).cast("string"),
                "view_byte_length": F.lit(None).cast("bigint"),
                "view_failure": F.when(html, F.lit("HTML_PARSE_FAILED")),
            }
        )
    else:
        # Only HTML rows look for a view; the others get keys that match nothing and
        # still spread over the partitions.
        wanted = F.when(html, F.col("sha256")).otherwise(F.concat(F.lit("-"), F.col("candidate_id")))
        joined = (
            joined.withColumn("_view_key", wanted)
            .join(views.withColumnRenamed("source_sha256", "_view_key"), "_view_key", "left")
        )
    joined = joined.withColumn(
        "_citation_text", F.when(html, F.col("view_text")).otherwise(F.col("text"))
    ).withColumn("_start", F.position(F.col("exact"), F.col("_citation_text")))
    view = F.col("citation_view")
    rules: list[Rule] = [
        (F.col("kind") == CANDIDATE_KIND, "INVALID_CANDIDATE_KIND"),
        (F.coalesce(F.col("exact"), F.lit("?")) != "", "SELECTOR_NOT_FOUND"),
        *_envelope_rules(CANDIDATE_KIND, max_bytes, transformation, max_quote_bytes)[1:],
        (_key("observed_at") <= _key("verified_at"), "VERIFICATION_TIME_INVALID"),
        *_integrity_rules(max_bytes),
        (html | F.col("text").isNotNull(), "CITATION_VIEW_INVALID"),
        (~html | F.col("view_failure").isNull(), F.col("view_failure")),
        (
            ~html
            | (
                (F.col("view_sha256") == view["sha256"])
                & (F.col("view_byte_length") == view["byte_length"])
            ),
            "CITATION_VIEW_HASH_MISMATCH",
        ),
        *_selector_rules(F.col("_citation_text"), F.col("_start")),
    ]
    decided = joined.withColumn("failure_code", first_failure(rules)).withColumn(
        "outcome", F.when(F.col("failure_code").isNull(), "verified").otherwise("rejected")
    )
    return _drop_working(decided).drop(
        "actual_length", "actual_sha256", "text",
        "view_text", "view_sha256", "view_byte_length", "view_failure",
    )


def promotion_record(decided: DataFrame) -> dict[str, DataFrame]:
    """Split gate outcomes into evidence, history payloads and attempts.

    All three are projections of the one ``decided`` table: write that table once and
    derive them from it, so that a partial write can always be completed. History rows
    are unlinked; ``chains.chain_build`` gives them their sequence links.
    """
    from quotelock.functions.digests import deterministic_id

    evidence_id = deterministic_id("evidence_", [F.col("candidate_id"), F.col("verified_at")])
    staged = decided.withColumn("evidence_id", evidence_id)
    verified = staged.where(F.col("outcome") == "verified")
    return {
        "evidence": verified.withColumn("kind", F.lit(EVIDENCE_KIND)).drop("failure_code", "outcome"),
        "history": verified.select(
            "candidate_id",
            "evidence_id",
            "snapshot_ref",
            F.col("verified_at").alias("promoted_at"),
        ),
        "attempts": staged.select(
            deterministic_id("attempt_", [F.col("candidate_id"), F.col("verified_at")]).alias("attempt_id"),
            "candidate_id",
            F.col("verified_at").alias("attempted_at"),
            "outcome",
            "failure_code",
        ),
    }
