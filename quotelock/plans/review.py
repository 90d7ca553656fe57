"""Review queries: status, attempts, web captures, redirects, targets and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.operators import captures as capture_ops
from quotelock.operators import review
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    ATTEMPTS_SQL,
    CANDIDATES_SQL,
    attempts,
    candidates,
    iso,
    iso_sql,
)

c = F.col


def _review_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with a persist time, evidence for a third, promotions for most of it."""
    base = candidates(spark, folder).withColumn(
        "persisted_at", iso(F.pmod(c("doc_id") * 7919, F.lit(100000)))
    )
    evidence = base.where(F.pmod("doc_id", F.lit(3)) == 0).select(
        "candidate_id", F.concat(F.lit("ev-"), c("doc_id").cast("string")).alias("evidence_id"), "doc_id"
    )
    promotions = evidence.where(F.pmod("doc_id", F.lit(9)) != 0).select(
        "candidate_id",
        F.when(F.pmod("doc_id", F.lit(15)) == 3, F.lit("ev-other")).otherwise(c("evidence_id")).alias("evidence_id"),
        c("doc_id").alias("sequence"),
    )
    return base, evidence, promotions


_REVIEW_SQL = f"""{CANDIDATES_SQL}, base AS (
  SELECT *, {iso_sql('(doc_id * 7919) % 100000')} AS persisted_at FROM candidates), {ATTEMPTS_SQL},
  last_attempt AS (SELECT candidate_id, max(sequence) AS attempt_sequence, arg_max(outcome, sequence) AS outcome,
      arg_max(coalesce(failure_code, ''), sequence) AS code FROM attempts GROUP BY 1),
  evidence AS (SELECT candidate_id, 'ev-' || doc_id AS evidence_id, doc_id FROM base WHERE doc_id % 3 = 0),
  promotions AS (SELECT candidate_id, CASE WHEN doc_id % 15 = 3 THEN 'ev-other' ELSE evidence_id END
      AS promotion_evidence_id FROM evidence WHERE doc_id % 9 <> 0),
  items AS (SELECT b.*, e.evidence_id, p.promotion_evidence_id, l.attempt_sequence, l.outcome,
      nullif(l.code, '') AS failure_code FROM base b LEFT JOIN evidence e ON e.candidate_id = b.candidate_id
      LEFT JOIN promotions p ON p.candidate_id = b.candidate_id
      LEFT JOIN last_attempt l ON l.candidate_id = b.candidate_id)"""
_DETAIL_STATUS = """CASE WHEN evidence_id IS NOT NULL THEN 'verified' WHEN outcome = 'rejected' THEN 'rejected'
      ELSE 'candidate' END"""


@query(
    f"""WITH {ATTEMPTS_SQL}
    SELECT candidate_id, max(sequence) AS sequence, arg_max(outcome, sequence) AS outcome FROM attempts GROUP BY 1"""
)
def latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    return review.latest_attempt(attempts(spark, folder)).select("candidate_id", "sequence", "outcome")


@query(
    f"""WITH {ATTEMPTS_SQL}
    SELECT candidate_id, sequence, outcome, failure_code, row_number() OVER (PARTITION BY candidate_id
      ORDER BY sequence DESC) AS rank FROM attempts"""
)
def attempt_list(spark: SparkSession, folder: str) -> DataFrame:
    listed = review.attempt_list(attempts(spark, folder))
    return listed.withColumn("rank", c("rank").cast("bigint"))


@query(
    f"""WITH {_REVIEW_SQL}
    SELECT candidate_id, evidence_id, promotion_evidence_id, attempt_sequence, failure_code,
      {_DETAIL_STATUS} AS status FROM items"""
)
def review_items(spark: SparkSession, folder: str) -> DataFrame:
    base, evidence, promotions = _review_tables(spark, folder)
    items = review.review_items(base, evidence, promotions, attempts(spark, folder))
    return items.select(
        "candidate_id", "evidence_id", "promotion_evidence_id", "attempt_sequence", "failure_code", "status"
    )


@query(
    f"""WITH {_REVIEW_SQL}
    SELECT candidate_id, persisted_at, exact AS quote, false AS quote_truncated, failure_code,
      CASE WHEN promotion_evidence_id = evidence_id THEN 'verified' WHEN outcome = 'rejected' THEN 'rejected'
        ELSE 'candidate' END AS status
    FROM items ORDER BY persisted_at DESC, candidate_id LIMIT 500"""
)
def review_list(spark: SparkSession, folder: str) -> DataFrame:
    base, evidence, promotions = _review_tables(spark, folder)
    summaries = review.review_summaries(base)
    listed = review.review_list(summaries, evidence, promotions, attempts(spark, folder), limit=500)
    return listed.select("candidate_id", "persisted_at", "quote", "quote_truncated", "failure_code", "status")


@query(
    f"""WITH {_REVIEW_SQL}, statuses AS (SELECT {_DETAIL_STATUS} AS status FROM items)
    SELECT count(*) AS all_items, count(*) FILTER (status = 'candidate') AS candidate,
      count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'verified') AS verified,
      false AS limited FROM statuses"""
)
def status_totals(spark: SparkSession, folder: str) -> DataFrame:
    base, evidence, promotions = _review_tables(spark, folder)
    return review.status_totals(
        review.review_items(base, evidence, promotions, attempts(spark, folder))
    )


# -- web captures from pages --------------------------------------------------------------


def _web_captures(spark: SparkSession, folder: str) -> DataFrame:
    """One capture per page; by ``page_id % 12`` one rule is broken."""
    form = F.pmod("page_id", F.lit(12))
    url = F.regexp_replace("url", "^http://", "https://")
    requested = F.regexp_replace(url, "^https://", "http://")
    html_type = F.lit("text/html; charset=utf-8")
    at = iso(c("page_id") * 60)
    hop = "array<struct<url:string,status:int,location:string>>"
    redirects = F.array(
        F.struct(requested.alias("url"), F.lit(301).alias("status"), url.alias("location"))
    ).cast(hop)
    sha = F.sha2("html", 256)
    size = F.octet_length("html").cast("bigint")
    staged = table(spark, folder, "pages").select(
        "page_id",
        F.concat(F.lit("cap-"), c("page_id").cast("string")).alias("capture_id"),
        F.when(form == 1, "Capture").otherwise("WebSourceCapture").alias("kind"),
        F.struct(
            html_type.alias("media_type"),
            F.when(form == 2, F.lit("none")).otherwise(sha).alias("sha256"),
            size.alias("byte_length"),
            F.lit("objects/x").alias("object_path"),
            F.when(form == 3, F.concat(url, F.lit("x"))).otherwise(url).alias("source_uri"),
            F.when(form == 4, F.substring(at, 1, 19)).otherwise(at).alias("captured_at"),
            at.alias("available_at"),
        ).alias("snapshot"),
        F.struct(
            sha.alias("sha256"),
            size.alias("byte_length"),
            F.lit("objects/y").alias("object_path"),
            F.when(form == 5, "gzip").otherwise("identity").alias("content_encoding"),
        ).alias("wire"),
        requested.alias("requested_url"),
        url.alias("canonical_url"),
        F.when(form == 6, F.array().cast(hop)).otherwise(redirects).alias("redirect_chain"),
        F.when(form == 7, 404).otherwise(200).alias("status"),
        F.create_map(
            F.when(form == 8, "server").otherwise("content-type"), html_type
        ).alias("headers"),
        at.alias("retrieved_at"),
        F.when(form == 9, iso(c("page_id") * 60 + 1)).otherwise(at).alias("available_at"),
        F.when(form == 10, "guess").otherwise("successful-http-response-completed").alias("availability_basis"),
    )
    return staged


@query(
    """SELECT 'cap-' || page_id AS capture_id, CASE page_id % 12 WHEN 1 THEN 'kind' WHEN 2 THEN 'snapshot.sha256'
         WHEN 3 THEN 'snapshot.source_uri = canonical_url' WHEN 4 THEN 'snapshot.captured_at'
         WHEN 5 THEN 'content-encoding = wire' WHEN 6 THEN 'redirect_chain' WHEN 7 THEN 'status' WHEN 8 THEN 'headers'
         WHEN 9 THEN 'available_at = retrieved_at' WHEN 10 THEN 'availability_basis' END AS failed_rule,
         CASE WHEN page_id % 12 BETWEEN 1 AND 10 THEN 'WEB_CAPTURE_INVALID' END AS failure_code FROM pages"""
)
def web_capture_validate(spark: SparkSession, folder: str) -> DataFrame:
    checked = capture_ops.web_capture_validate(_web_captures(spark, folder))
    return checked.select("capture_id", "failed_rule", "failure_code")


@query(
    """SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'REDIRECT_CHAIN_BROKEN' WHEN 2 THEN 'REDIRECT_CANONICAL_MISMATCH'
         WHEN 3 THEN 'REDIRECT_LIMIT' WHEN 4 THEN 'REDIRECT_INVALID' WHEN 5 THEN 'REDIRECT_UNRESOLVED' END AS failure_code
       FROM pages"""
)
def redirect_chain_check(spark: SparkSession, folder: str) -> DataFrame:
    """Two hops, the second root-relative; by ``page_id % 9`` 1-5 break a rule, 6 has no hop."""
    form = F.pmod("page_id", F.lit(9))
    number = c("page_id").cast("string")
    start = F.concat(F.lit("http://a.example/"), number)
    middle = F.concat(F.lit("https://b.example/m/"), number)
    end = F.concat(F.lit("https://b.example/end/"), number)
    location = F.when(form == 5, F.lit("../up")).otherwise(F.concat(F.lit("/end/"), number))
    first = F.struct(
        start.alias("url"), F.when(form == 4, 200).otherwise(302).alias("status"), middle.alias("location")
    )
    second = F.struct(
        F.when(form == 1, end).otherwise(middle).alias("url"), F.lit(308).alias("status"), location.alias("location")
    )
    hops = F.array(first, second)
    chain = F.when(form == 3, F.concat(hops, hops, hops)).when(form == 6, F.slice(hops, 1, 0)).otherwise(hops)
    canonical = F.when(form == 2, middle).when(form == 6, start).otherwise(end)
    rows = table(spark, folder, "pages").select(
        "page_id", start.alias("requested_url"), canonical.alias("canonical_url"), chain.alias("redirect_chain")
    )
    return capture_ops.redirect_chain_check(rows).select("page_id", "failure_code")


_TARGETS = (
    ("http://127.0.0.1/{}", "ADDRESS_BLOCKED"),
    ("http://10.1.2.{}/", "ADDRESS_BLOCKED"),
    ("https://user:pw@host.example/{}", "CREDENTIALS_BLOCKED"),
    ("ftp://host.example/{}", "SCHEME_BLOCKED"),
    ("http://[2001:db8::{}]/", "ADDRESS_BLOCKED"),
    ("http://[2606:4700::{}]/", "PUBLIC"),
    ("http://8.8.4.{}/", "PUBLIC"),
    ("no address {}", "INVALID_URL"),
    ("http://[::ffff:192.168.0.{}]/", "ADDRESS_BLOCKED"),
    ("http://198.18.7.{}/", "ADDRESS_BLOCKED"),
    ("http://172.32.0.{}/", "PUBLIC"),
    ("http://224.0.0.{}/", "ADDRESS_BLOCKED"),
)


@query(
    "SELECT page_id, CASE page_id % 13 "
    + " ".join(f"WHEN {number + 1} THEN '{policy}'" for number, (_, policy) in enumerate(_TARGETS))
    + " ELSE 'PUBLIC' END AS policy FROM pages"
)
def target_policy_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs, and by ``page_id % 13`` URLs of every blocked kind."""
    form = F.pmod("page_id", F.lit(13))
    octet = F.pmod("page_id", F.lit(200)).cast("string")
    url = F.when(form == 0, c("url"))
    for number, (pattern, _) in enumerate(_TARGETS):
        head, tail = pattern.split("{}")
        url = url.when(form == number + 1, F.concat(F.lit(head), octet, F.lit(tail)))
    rows = table(spark, folder, "pages").select("page_id", url.alias("url"))
    return capture_ops.target_policy_audit(rows).select("page_id", "policy")


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'CAPTURE_MISSING'
         WHEN page_id % 5 = 2 THEN 'CAPTURE_AMBIGUOUS' WHEN page_id % 5 = 3 THEN 'CAPTURE_MISMATCH' END AS failure_code,
         CASE WHEN page_id % 5 = 4 THEN 'cap-' || page_id || '-1' END AS capture_id,
         CAST([1, 0, 2, 1, 1][page_id % 5 + 1] AS BIGINT) AS capture_count FROM pages"""
)
def capture_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """By ``page_id % 5``: 0 a local source, 1 no capture, 2 two, 3 one that differs, 4 one."""
    form = F.pmod("page_id", F.lit(5))
    number = c("page_id").cast("string")
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.concat(F.lit("snap-"), number).alias("snapshot_ref"),
        F.sha2("html", 256).alias("snapshot_digest"),
        F.when(form == 0, "local").otherwise("web").alias("source_kind"),
    )
    copies = F.when(form == 2, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1")))
    stored = (
        pages.where(form != 1)
        .withColumn("_copy", F.explode(copies))
        .select(
            F.concat(F.lit("cap-"), number, F.lit("-"), "_copy").alias("capture_id"),
            "snapshot_ref",
            F.when(form == 3, F.sha2("snapshot_digest", 256)).otherwise(c("snapshot_digest")).alias("snapshot_digest"),
        )
    )
    return review.capture_linkage(pages, stored).select(
        "page_id", "failure_code", "capture_id", "capture_count"
    )


# -- runs and traces from events ------------------------------------------------------------


@query(
    """WITH reports AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS recorded,
         sha256('run:' || CASE WHEN event_id % 50 = 7 THEN 0 ELSE event_id END) AS head_sha256, event_type AS gate, props AS ledger FROM events)
    SELECT event_id, gate IS DISTINCT FROM lag(gate) OVER w AND lag(event_id) OVER w IS NOT NULL AS gate_changed,
      ledger IS DISTINCT FROM lag(ledger) OVER w AND lag(event_id) OVER w IS NOT NULL AS ledger_changed,
      CASE WHEN count(*) OVER (PARTITION BY user_id, head_sha256) > 1 THEN 'REPORT_HEAD_DUPLICATE' END AS failure_code
    FROM reports WINDOW w AS (PARTITION BY user_id ORDER BY recorded, event_id)"""
)
def run_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events are runs of one stack, compared with the run before."""
    head = F.when(F.pmod("event_id", F.lit(50)) == 7, 0).otherwise(c("event_id"))
    recorded = F.unix_seconds(F.date_trunc("second", c("ts").cast("timestamp")))
    runs = table(spark, folder, "events").select(
        "user_id",
        "event_id",
        F.struct(recorded.alias("at"), c("event_id").alias("id")).alias("recorded"),
        F.sha2(F.concat(F.lit("run:"), head.cast("string")), 256).alias("head_sha256"),
        c("event_type").alias("gate"),
        c("props").alias("ledger"),
    )
    day = F.floor(c("recorded.at") / 86400)
    changes = {"gate_changed": "gate", "ledger_changed": "ledger"}
    compared = review.run_diff(runs, ["user_id"], "recorded", day, changes)
    return compared.select(
        "event_id",
        F.coalesce("gate_changed", F.lit(False)).alias("gate_changed"),
        F.coalesce("ledger_changed", F.lit(False)).alias("ledger_changed"),
        "failure_code",
    )


@query(
    """WITH traces AS (SELECT event_id // 4 AS run_id, event_id % 4 AS place, (event_id // 4) % 9 AS form, props FROM events),
    runs AS (SELECT run_id, form, count(*) AS n, count(*) FILTER (contains(props, '"k": 99')) AS leaks FROM traces
      WHERE NOT (form = 1 AND place = 3) GROUP BY 1, 2)
    SELECT run_id, n AS events, CASE WHEN leaks > 0 THEN 'TRACE_FORBIDDEN_CONTENT' WHEN form = 2 THEN 'TRACE_MALFORMED'
      WHEN n <> 4 THEN 'TRACE_EVENT_COUNT' WHEN form = 3 THEN 'TRACE_CONTENT_MODE' WHEN form = 4 THEN 'TRACE_NOT_PRIVATE'
      WHEN form = 5 THEN 'TRACE_LIFECYCLE_INCOMPLETE' WHEN form = 6 THEN 'TRACE_COMMAND_FAILED' END AS failure_code
    FROM runs"""
)
def trace_privacy_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Four events make a run; by ``run_id % 9`` one rule is broken."""
    run = F.floor(c("event_id") / 4)
    place = F.pmod("event_id", F.lit(4))
    form = F.pmod(run, F.lit(9))
    started = F.when(place % 2 == 0, "command.started").otherwise("command.finished")
    trace = table(spark, folder, "events").where(~((form == 1) & (place == 3))).select(
        run.alias("run_id"),
        F.when((form == 5) & (place == 0), "tool.started").otherwise(started).alias("event_type"),
        F.when((form == 3) & (place == 0), "raw").otherwise("metadata_only").alias("content_mode"),
        F.when((form == 4) & (place == 1), "public").otherwise("private").alias("sensitivity"),
        F.when((form == 6) & (place == 1), 1).otherwise(0).alias("exit_code"),
        F.when(~((form == 2) & (place == 2)) | F.contains("props", F.lit('"k": 99')), c("props")).alias("payload"),
    )
    return capture_ops.trace_privacy_audit(trace, "run_id", forbidden=['"k": 99'])
