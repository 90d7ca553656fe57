"""Retained web captures, their redirects and targets, and private traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import is_digest
from quotelock.functions.instants import is_canonical_instant
from quotelock.functions.ladder import bounded_chars, first_failure, holds, whole_number
from quotelock.functions.records import RETAINED_HEADERS
from quotelock.functions.urls import is_http_url, resolve_location, target_policy

MAX_REDIRECTS = 5
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
AVAILABILITY_BASIS = "successful-http-response-completed"
TRACE_EVENTS = 4
PRIVATE_MODES = ("metadata_only", "hash_only")


def target_policy_audit(targets: DataFrame, url: str = "url") -> DataFrame:
    """Classify URL targets; anything but PUBLIC may not be captured."""
    return targets.withColumn("policy", target_policy(F.col(url)))


def redirect_code(max_hops: int = MAX_REDIRECTS) -> Column:
    """Rules on ``requested_url``, ``canonical_url`` and ``redirect_chain``.

    The chain is short by rule, so hops are compared inside the row.
    """
    c = F.col
    hops = c("redirect_chain")
    resolved = F.transform(hops, lambda hop: resolve_location(hop["url"], hop["location"]))
    expected = F.concat(F.array(c("requested_url")), resolved)
    followed = F.forall(
        F.zip_with(
            hops, F.slice(expected, F.lit(1), F.size(hops)), lambda hop, url: hop["url"].eqNullSafe(url)
        ),
        lambda same: same,
    )
    shaped = F.forall(
        hops,
        lambda hop: holds(
            is_http_url(hop["url"])
            & hop["status"].isin(*REDIRECT_STATUSES)
            & F.char_length(hop["location"]).between(1, 8192)
        ),
    )
    return first_failure(
        [
            (hops.isNotNull() & (F.size(hops) <= max_hops), "REDIRECT_LIMIT"),
            (shaped, "REDIRECT_INVALID"),
            (F.forall(resolved, lambda url: url.isNotNull()), "REDIRECT_UNRESOLVED"),
            (followed, "REDIRECT_CHAIN_BROKEN"),
            (
                F.try_element_at(expected, F.lit(-1)) == c("canonical_url"),
                "REDIRECT_CANONICAL_MISMATCH",
            ),
        ]
    )


def redirect_chain_check(captures: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Each hop leads to the next and the last one to the canonical URL."""
    return captures.withColumn("failure_code", redirect_code(max_hops))


def web_capture_validate(captures: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Cross-field rules of a retained capture.

    Adds ``failed_rule``, the first rule that does not hold, and ``failure_code``, which is
    WEB_CAPTURE_INVALID for any of them.
    """
    c = F.col
    snapshot, wire, headers = c("snapshot"), c("wire"), c("headers")

    def header(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(default))

    rules = [
        (c("kind") == "WebSourceCapture", "kind"),
        (bounded_chars(c("capture_id"), 256), "capture_id"),
        (bounded_chars(snapshot["media_type"], 1024), "snapshot.media_type"),
        (is_digest(snapshot["sha256"]), "snapshot.sha256"),
        (whole_number(snapshot["byte_length"], 0, max_bytes), "snapshot.byte_length"),
        (bounded_chars(snapshot["object_path"], 4096), "snapshot.object_path"),
        (is_http_url(snapshot["source_uri"]), "snapshot.source_uri"),
        (is_canonical_instant(snapshot["captured_at"]), "snapshot.captured_at"),
        (is_canonical_instant(snapshot["available_at"]), "snapshot.available_at"),
        (is_digest(wire["sha256"]), "wire.sha256"),
        (whole_number(wire["byte_length"], 0, max_bytes), "wire.byte_length"),
        (bounded_chars(wire["object_path"], 4096), "wire.object_path"),
        (bounded_chars(wire["content_encoding"], 128), "wire.content_encoding"),
        (is_http_url(c("requested_url")), "requested_url"),
        (is_http_url(c("canonical_url")), "canonical_url"),
        (whole_number(c("status"), 200, 299), "status"),
        (is_canonical_instant(c("retrieved_at")), "retrieved_at"),
        (is_canonical_instant(c("available_at")), "available_at"),
        (c("availability_basis") == AVAILABILITY_BASIS, "availability_basis"),
        (c("available_at") == c("retrieved_at"), "available_at = retrieved_at"),
        (snapshot["available_at"] == c("available_at"), "snapshot.available_at = available_at"),
        (snapshot["captured_at"] == c("retrieved_at"), "snapshot.captured_at = retrieved_at"),
        (snapshot["source_uri"] == c("canonical_url"), "snapshot.source_uri = canonical_url"),
        (redirect_code().isNull(), "redirect_chain"),
        (
            F.forall(F.map_keys(headers), lambda name: name.isin(*RETAINED_HEADERS))
            & F.forall(
                F.map_values(headers), lambda value: F.coalesce(F.char_length(value) <= 8192, F.lit(False))
            ),
            "headers",
        ),
        (
            header("content-type", "application/octet-stream") == snapshot["media_type"],
            "content-type = media_type",
        ),
        (
            header("content-encoding", "identity") == wire["content_encoding"],
            "content-encoding = wire",
        ),
    ]
    return captures.withColumn("failed_rule", first_failure(rules)).withColumn(
        "failure_code", F.when(F.col("failed_rule").isNotNull(), "WEB_CAPTURE_INVALID")
    )


def trace_privacy_audit(
    events: DataFrame, run: str, forbidden: Sequence[str] = (), expected_events: int = TRACE_EVENTS
) -> DataFrame:
    """One code per run of a trace, NULL when the trace may be kept.

    ``events``: run column, ``event_type``, ``content_mode``, ``sensitivity``, ``exit_code``
    and ``payload`` (NULL when it was not JSON). ``forbidden`` is the short list of strings
    that must not be retained; it is checked row by row.
    """
    c = F.col
    leaks = F.lit(False)
    for value in forbidden:
        if value:
            leaks = leaks | F.contains(c("payload"), F.lit(value))
    half = expected_events // 2
    kind = c("event_type")
    totals = events.groupBy(run).agg(
        F.count("*").alias("events"),
        F.count_if(holds(leaks)).alias("_leaks"),
        F.count_if(c("payload").isNull()).alias("_malformed"),
        F.count_if(~holds(c("content_mode").isin(*PRIVATE_MODES))).alias("_modes"),
        F.count_if(~holds(c("sensitivity") == "private")).alias("_public"),
        F.count_if(holds(kind == "command.started")).alias("_started"),
        F.count_if(holds(kind == "command.finished")).alias("_finished"),
        F.count_if(holds(kind == "command.finished") & ~holds(c("exit_code") == 0)).alias("_failed"),
    )
    code = first_failure(
        [
            (c("_leaks") == 0, "TRACE_FORBIDDEN_CONTENT"),
            (c("_malformed") == 0, "TRACE_MALFORMED"),
            (c("events") == expected_events, "TRACE_EVENT_COUNT"),
            (c("_modes") == 0, "TRACE_CONTENT_MODE"),
            (c("_public") == 0, "TRACE_NOT_PRIVATE"),
            ((c("_started") == half) & (c("_finished") == half), "TRACE_LIFECYCLE_INCOMPLETE"),
            (c("_failed") == 0, "TRACE_COMMAND_FAILED"),
        ]
    )
    return totals.select(run, "events", code.alias("failure_code"))
