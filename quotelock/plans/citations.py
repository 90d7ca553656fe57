"""Citation queries: capture, gate, resolve, and what is recorded of the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest
from quotelock.functions.records import snapshot_members
from quotelock.operators import chains as chain_ops
from quotelock.operators import cite, export, gate, review
from quotelock.plans.checkpoints import cut_lineage
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    CANDIDATES_SQL,
    DECIDED_SQL,
    ENVELOPE_CASES,
    INTEGRITY_CASES,
    SELECTOR_CASES,
    SNAPSHOTS_SQL,
    candidates,
    decided,
    iso,
    iso_sql,
    snapshots,
)
from quotelock.sources import snapshots as snapshot_ops

c = F.col


@query(
    f"""WITH {DECIDED_SQL}
    SELECT candidate_id, CASE WHEN failure_code IS NULL THEN 'verified' ELSE 'rejected' END AS outcome, failure_code
    FROM decided"""
)
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    return decided(spark, folder).select("candidate_id", "outcome", "failure_code")


_CAPTURE_SQL = f"""captured AS (
  SELECT doc_id, text, CASE doc_id % 8 WHEN 1 THEN substr({iso_sql('doc_id')}, 1, 10)
           WHEN 2 THEN '2026-02-30T00:00:00Z' WHEN 3 THEN {iso_sql('doc_id + 172800')}
           ELSE {iso_sql('doc_id')} END AS available_at,
         {iso_sql('doc_id + 86400')} AS captured_at FROM documents), coded AS (
  SELECT *, CASE WHEN doc_id % 8 = 2 THEN 'INVALID_TIMESTAMP' WHEN doc_id % 8 = 3 THEN 'TIMESTAMP_ORDER_INVALID'
      WHEN doc_id % 8 = 4 THEN 'SOURCE_NOT_UTF8' END AS code
  FROM captured), kept AS (
  SELECT *, sha256(text) AS sha, CASE WHEN length(available_at) = 10 THEN available_at || 'T00:00:00.000Z'
      ELSE available_at END AS available FROM coded)"""


def _captured(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 8``: 1 date only, 2 no such day, 3 available later, 4 not UTF-8."""
    form = F.pmod("doc_id", F.lit(8))
    sources = table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("file:///corpus/"), c("doc_id").cast("string"), F.lit(".txt")).alias("source_uri"),
        F.when(form == 4, F.concat(F.lit("a").cast("binary"), F.unhex(F.lit("FF"))))
        .otherwise(c("text").cast("binary"))
        .alias("content"),
    )
    available = (
        F.when(form == 1, F.substring(iso(c("doc_id")), 1, 10))
        .when(form == 2, F.lit("2026-02-30T00:00:00Z"))
        .when(form == 3, iso(c("doc_id") + 172800))
        .otherwise(iso(c("doc_id")))
    )
    return snapshot_ops.capture_snapshots(
        sources, available, iso(c("doc_id") + 86400)
    )


@query(
    f"""WITH {_CAPTURE_SQL}
    SELECT doc_id, code AS failure_code, CASE WHEN code IS NULL THEN sha END AS sha256,
      CASE WHEN code IS NULL THEN CAST(strlen(text) AS BIGINT) END AS byte_length,
      CASE WHEN code IS NULL THEN available END AS available_at,
      CASE WHEN code IS NULL THEN 'snapshot_' || sha256('{{"availableAt":"' || available || '","byteLength":' ||
        strlen(text) || ',"capturedAt":"' || captured_at || '","mediaType":"text/plain; charset=utf-8","objectPath":"objects/sha256/'
        || substr(sha, 1, 2) || '/' || substr(sha, 3) || '","sha256":"' || sha || '","sourceUri":"file:///corpus/' ||
        doc_id || '.txt"}}') END AS snapshot_ref FROM kept"""
)
def snapshot_capture(spark: SparkSession, folder: str) -> DataFrame:
    return _captured(spark, folder).select(
        "doc_id",
        "failure_code",
        "snapshot.sha256",
        "snapshot.byte_length",
        "snapshot.available_at",
        "snapshot_ref",
    )


@query(
    """WITH incoming AS (SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies
         FROM documents GROUP BY 1),
    store AS (SELECT DISTINCT sha256(text) AS sha256,
        CASE WHEN substr(sha256(text), 1, 1) = '0' THEN sha256('x' || text)
          WHEN substr(sha256(text), 1, 1) <> '1' THEN sha256(text) END AS stored_sha256
      FROM documents WHERE doc_id % 3 = 0)
    SELECT i.sha256, i.first_doc, i.copies, CASE WHEN s.sha256 IS NULL THEN 'store'
      WHEN s.stored_sha256 = i.sha256 THEN 'present' ELSE 'SNAPSHOT_HASH_MISMATCH' END AS outcome
    FROM incoming i LEFT JOIN store s ON s.sha256 = i.sha256"""
)
def content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the contents is stored already; some stored objects are corrupt or unreadable."""
    rows = table(spark, folder, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    corrupt = F.sha2(F.concat(F.lit("x"), c("text")), 256)
    store = (
        rows.where(F.pmod("doc_id", F.lit(3)) == 0)
        .select(
            "sha256",
            F.when(F.substring("sha256", 1, 1) == "0", corrupt)
            .when(F.substring("sha256", 1, 1) != "1", c("sha256"))
            .alias("stored_sha256"),
        )
        .distinct()
    )
    incoming = rows.select(c("doc_id").alias("snapshot_ref"), "sha256")
    return snapshot_ops.content_dedupe(incoming, store).withColumnRenamed("snapshot_ref", "first_doc")


@query(
    f"""WITH {CANDIDATES_SQL}
    SELECT candidate_id, CASE {ENVELOPE_CASES} END AS failure_code FROM candidates c"""
)
def envelope_validate(spark: SparkSession, folder: str) -> DataFrame:
    return gate.envelope_validate(candidates(spark, folder)).select("candidate_id", "failure_code")


@query(
    f"""WITH {CANDIDATES_SQL}
    SELECT c.candidate_id, CASE {INTEGRITY_CASES} END AS failure_code
    FROM candidates c LEFT JOIN snapshots s ON s.snapshot_ref = c.snapshot_ref"""
)
def snapshot_integrity(spark: SparkSession, folder: str) -> DataFrame:
    stored = snapshots(spark, folder).select("snapshot_ref", "content")
    return gate.snapshot_integrity(candidates(spark, folder), stored).select("candidate_id", "failure_code")


@query(
    f"""WITH {CANDIDATES_SQL}
    SELECT c.candidate_id, CASE {SELECTOR_CASES} END AS failure_code
    FROM candidates c JOIN snapshots s ON s.doc_id = c.doc_id"""
)
def selector_check(spark: SparkSession, folder: str) -> DataFrame:
    texts = snapshots(spark, folder).select("doc_id", c("content").alias("text"))
    joined = candidates(spark, folder).join(texts, "doc_id")
    return gate.selector_check(joined).select("candidate_id", "failure_code")


@query(
    f"""WITH {CANDIDATES_SQL}
    SELECT candidate_id, CASE
      WHEN length(available_at) = 10 OR try_cast(captured_at AS TIMESTAMP) IS NULL THEN 'INVALID_TIMESTAMP'
      WHEN CAST(available_at AS TIMESTAMP) > CAST(captured_at AS TIMESTAMP)
        OR CAST(captured_at AS TIMESTAMP) > CAST(observed_at AS TIMESTAMP) THEN 'TIMESTAMP_ORDER_INVALID'
      WHEN CAST(observed_at AS TIMESTAMP) > CAST(verified_at AS TIMESTAMP) THEN 'VERIFICATION_TIME_INVALID'
      END AS failure_code FROM candidates"""
)
def timestamp_order(spark: SparkSession, folder: str) -> DataFrame:
    return gate.timestamp_order(candidates(spark, folder)).select("candidate_id", "failure_code")


# -- resolving quotes ------------------------------------------------------------------


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(c("doc_id").alias("capture_id"), "text")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """A quote per document; by ``doc_id % 6``: 3 absent, 4 empty, 5 an unknown capture."""
    form = F.pmod("doc_id", F.lit(6))
    exact = F.substring("text", 10, 60)
    return table(spark, folder, "documents").select(
        F.when(form == 5, -1 - c("doc_id")).otherwise(c("doc_id")).alias("capture_id"),
        "doc_id",
        F.when(form == 3, F.concat(exact, F.lit("¤")))
        .when(form == 4, F.lit(""))
        .otherwise(exact)
        .alias("exact"),
    )


@query(
    """WITH asked AS (
      SELECT doc_id, text, CASE doc_id % 6 WHEN 3 THEN substr(text, 10, 60) || '¤' WHEN 4 THEN ''
          ELSE substr(text, 10, 60) END AS exact FROM documents), placed AS (
      SELECT *, strpos(text, exact) AS p FROM asked), coded AS (
      SELECT *, CASE WHEN exact = '' THEN 'SELECTOR_NOT_FOUND' WHEN doc_id % 6 = 5 THEN 'WEB_CAPTURE_NOT_PERSISTED'
        WHEN p = 0 THEN 'SELECTOR_NOT_FOUND' WHEN strpos(substr(text, p + 1), exact) > 0 THEN 'SELECTOR_AMBIGUOUS'
        END AS failure_code FROM placed)
    SELECT doc_id, failure_code,
      CASE WHEN failure_code IS NULL THEN 'candidate_web_' || sha256('["' || doc_id || '",' || to_json(exact) || ']')
        END AS candidate_id,
      CASE WHEN failure_code IS NULL THEN substr(text, greatest(1, p - 32), p - greatest(1, p - 32)) END AS prefix,
      CASE WHEN failure_code IS NULL THEN substr(text, p + length(exact), 32) END AS suffix FROM coded"""
)
def cite_by_source(spark: SparkSession, folder: str) -> DataFrame:
    cited = cite.cite_by_source(_asked(spark, folder), _captures(spark, folder))
    return cited.select("doc_id", "failure_code", "candidate_id", "prefix", "suffix")


@query(
    """WITH stored AS (
      SELECT doc_id, text, doc_id % 6 AS form, CASE WHEN length(text) < 80 THEN text ELSE substr(text, 10, 60) END AS exact
      FROM documents), coded AS (
      SELECT *, CASE WHEN form = 4 THEN 'SNAPSHOT_MISSING' WHEN form = 2 THEN 'SNAPSHOT_SIZE_MISMATCH'
          WHEN form = 1 AND NOT starts_with(text, '#') THEN CASE WHEN strlen(substr(text, 1, 1)) > 1
            THEN 'SNAPSHOT_SIZE_MISMATCH' ELSE 'SNAPSHOT_HASH_MISMATCH' END
          WHEN form = 3 THEN 'CITATION_VIEW_INVALID' WHEN form = 5 THEN 'HTML_PARSE_FAILED' END AS capture_failure
      FROM stored)
    SELECT doc_id, capture_failure, CASE WHEN exact = '' THEN 'SELECTOR_NOT_FOUND' WHEN capture_failure IS NOT NULL
        THEN capture_failure WHEN strpos(substr(text, strpos(text, exact) + 1), exact) > 0 THEN 'SELECTOR_AMBIGUOUS'
        END AS failure_code
    FROM coded"""
)
def intact_captures(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 6``: 1 first character changed, 2 bytes added, 3 other charset, 4 no bytes, 5 HTML not rendered."""
    form = F.pmod("doc_id", F.lit(6))
    rest = F.substring("content", F.lit(2), F.char_length("content"))
    kept = snapshots(spark, folder)
    captures = kept.select(
        c("doc_id").alias("capture_id"),
        "snapshot_ref",
        "sha256",
        "byte_length",
        F.when(form == 3, "text/plain; charset=latin-1").when(form == 5, "text/html").otherwise(c("media_type")).alias("media_type"),
    )
    stored = kept.where(form != 4).select(
        "snapshot_ref",
        F.when(form == 1, F.concat(F.lit("#"), rest))
        .when(form == 2, F.concat("content", F.lit("#")))
        .otherwise(c("content"))
        .alias("content"),
    )
    exact = F.when(F.char_length("text") < 80, c("text")).otherwise(F.substring("text", 10, 60))
    quotes = table(spark, folder, "documents").select(c("doc_id").alias("capture_id"), "doc_id", exact.alias("exact"))
    cited = cite.cite_by_source(quotes, cite.intact_captures(captures, stored))
    return cited.select("doc_id", "capture_failure", "failure_code")


def _previews(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 5``: 0 exact quote, 1 two characters, 2 blanks widened, 3 absent, 4 blank."""
    form = F.pmod("doc_id", F.lit(5))
    short = F.char_length("text") < 80
    exact = F.when(short, c("text")).otherwise(F.substring("text", 10, 60))
    asked = (
        F.when(form == 1, F.substring(exact, 1, 2))
        .when(form == 2, F.regexp_replace(exact, r"\s+", "  "))
        .when(form == 3, F.concat(exact, F.lit("¤")))
        .when(form == 4, F.lit(" \n "))
        .otherwise(exact)
    )
    queries = table(spark, folder, "documents").select(c("doc_id").alias("capture_id"), asked.alias("query"))
    return cite.citation_preview(queries, _captures(spark, folder))


_PREVIEW_SQL = r"""asked AS (
  SELECT doc_id AS capture_id, text, CASE doc_id % 5 WHEN 1 THEN substr(quote, 1, 2)
      WHEN 2 THEN regexp_replace(quote, '\s+', '  ', 'g')
      WHEN 3 THEN quote || '¤' WHEN 4 THEN ' ' || chr(10) || ' ' ELSE quote END AS query
  FROM (SELECT *, CASE WHEN length(text) < 80 THEN text ELSE substr(text, 10, 60) END AS quote FROM documents)), usable AS (
  SELECT *, trim(regexp_replace(query, '\s+', ' ', 'g')) = '' AS bad, string_split(text, '') AS chars,
    regexp_replace(text, '\s+', ' ', 'g') AS flat, trim(regexp_replace(query, '\s+', ' ', 'g')) AS flat_query
  FROM asked), exact_hits AS (
  SELECT *, CASE WHEN bad THEN [] ELSE list_filter(list_filter(range(1, len(chars) + 1),
      lambda i: starts_with(chars[i] || coalesce(chars[i + 1], ''), substr(query, 1, 2))), lambda i: substr(text, i, length(query)) = query)
      END AS hits, string_split(flat, '') AS flat_chars FROM usable), blank_hits AS (
  SELECT *, CASE WHEN bad OR len(hits) > 0 THEN [] ELSE list_filter(list_filter(range(1, len(flat_chars) + 1),
      lambda i: starts_with(flat_chars[i] || coalesce(flat_chars[i + 1], ''), substr(flat_query, 1, 2))),
      lambda i: substr(flat, i, length(flat_query)) = flat_query) END AS loose FROM exact_hits), previews AS (
  SELECT capture_id, text, query, hits, CASE WHEN bad THEN 'CITATION_QUERY_INVALID' END AS failure_code,
    CASE WHEN bad THEN NULL WHEN len(hits) > 0 THEN 'exact' WHEN len(loose) > 0 THEN 'normalized-whitespace'
      ELSE 'none' END AS match_mode,
    CASE WHEN NOT bad THEN CAST(least(20, len(hits) + len(loose)) AS BIGINT) END AS match_count,
    CASE WHEN NOT bad THEN len(hits) + len(loose) > 20 END AS truncated,
    CASE WHEN len(hits) > 0 THEN substr(text, greatest(1, hits[1] - 80), hits[1] - greatest(1, hits[1] - 80)) END
      AS exact_prefix,
    CASE WHEN len(hits) > 0 THEN query WHEN len(loose) > 0 THEN
      regexp_extract(text, array_to_string(list_transform(string_split(flat_query, ' '), lambda w: regexp_escape(w)), '\s+'))
      END AS first_exact
  FROM blank_hits)"""


@query(
    f"""WITH {_PREVIEW_SQL}
    SELECT capture_id, failure_code, match_mode, match_count, truncated, first_exact, exact_prefix FROM previews"""
)
def citation_preview(spark: SparkSession, folder: str) -> DataFrame:
    first = F.get("matches", F.lit(0))
    return _previews(spark, folder).select(
        "capture_id",
        "failure_code",
        "match_mode",
        F.when(c("matches").isNotNull(), F.size("matches")).cast("bigint").alias("match_count"),
        "truncated",
        first["exact"].alias("first_exact"),
        F.when(c("match_mode") == "exact", first["prefix"]).alias("exact_prefix"),
    )


@query(
    f"""WITH {_PREVIEW_SQL}
    SELECT capture_id, CASE WHEN failure_code IS NOT NULL THEN failure_code WHEN match_count = 0
        THEN 'SELECTOR_NOT_FOUND' WHEN match_count > 1 OR truncated THEN 'SELECTOR_AMBIGUOUS' END AS failure_code,
      CASE WHEN match_count = 1 AND NOT truncated THEN first_exact END AS exact FROM previews"""
)
def unique_citation(spark: SparkSession, folder: str) -> DataFrame:
    return cite.unique_citation(_previews(spark, folder)).select("capture_id", "failure_code", "exact")


@query(
    """WITH quotes AS (
      SELECT 'b' || item_id AS quote_id, text AS exact FROM benchmark UNION ALL
      SELECT 'w' || item_id, string_split(text, chr(10))[1] FROM benchmark),
    found AS (SELECT q.quote_id, q.exact, d.doc_id, d.text, strpos(d.text, q.exact) AS start
      FROM quotes q JOIN documents d ON contains(d.text, q.exact)),
    counted AS (SELECT *, strpos(substr(text, start + 1), exact) > 0 AS repeated,
      count(*) OVER (PARTITION BY quote_id) AS document_count FROM found)
    SELECT quote_id, doc_id, CAST(start AS BIGINT) AS start, repeated, document_count,
      document_count = 1 AND NOT repeated AS corpus_unique FROM counted"""
)
def quote_locate(spark: SparkSession, folder: str) -> DataFrame:
    """Whole benchmark items, and their first lines, located in all documents."""
    items = table(spark, folder, "benchmark")
    quotes = items.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("b"), "item_id").alias("quote_id"), c("text").alias("exact")),
                F.struct(
                    F.concat(F.lit("w"), "item_id").alias("quote_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("exact")
                ),
            )
        )
    )
    documents = table(spark, folder, "documents").select("doc_id", "text")
    located = cut_lineage(cite.quote_locate(quotes, documents))
    return located.join(cite.corpus_unique(located), "quote_id").withColumn("start", c("start").cast("bigint"))


# -- recording outcomes ------------------------------------------------------------------

_EVIDENCE_SQL = """evidence AS (
  SELECT *, 'evidence_' || sha256('["' || candidate_id || '","' || verified_at || '"]') AS evidence_id
  FROM decided WHERE failure_code IS NULL)"""
_HISTORY_SQL = f"""{_EVIDENCE_SQL}, numbered AS (
  SELECT candidate_id, evidence_id, snapshot_ref, verified_at AS promoted_at,
    doc_id // 1000 AS shard, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS sequence
  FROM evidence), history AS (
  SELECT n.*, CAST(NULL AS VARCHAR) AS previous_record_sha256, sha256('{{"candidateId":"' || candidate_id ||
      '","evidenceId":"' || evidence_id || '","previousRecordSha256":null,"promotedAt":"' || promoted_at ||
      '","snapshotRef":"' || snapshot_ref || '"}}') AS record_sha256 FROM numbered n WHERE sequence = 1
  UNION ALL
  SELECT n.*, h.record_sha256, sha256('{{"candidateId":"' || n.candidate_id || '","evidenceId":"' || n.evidence_id ||
      '","previousRecordSha256":"' || h.record_sha256 || '","promotedAt":"' || n.promoted_at ||
      '","snapshotRef":"' || n.snapshot_ref || '"}}')
  FROM numbered n JOIN history h ON n.shard = h.shard AND n.sequence = h.sequence + 1)"""


@query(
    f"""WITH RECURSIVE {DECIDED_SQL}, {_HISTORY_SQL}
    SELECT d.candidate_id, CASE WHEN d.failure_code IS NULL THEN 'verified' ELSE 'rejected' END AS attempt_outcome,
      d.failure_code, h.evidence_id, h.previous_record_sha256, h.record_sha256
    FROM decided d LEFT JOIN history h ON h.candidate_id = d.candidate_id"""
)
def promotion_record(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts beside the linked history row of what was verified.

    A history is a chain of its own per thousand documents, linked in document order.
    """
    parts = gate.promotion_record(decided(spark, folder))
    from quotelock.plans.blocks import running_sum

    document = F.substring_index("candidate_id", "-", -1).cast("bigint")
    staged = parts["history"].withColumns(
        {"_doc": document, "shard": F.floor(document / 1000)}
    )
    numbered = running_sum(staged, ["shard"], "_doc", F.lit(1), "sequence").drop("_doc")
    history = chain_ops.chain_build(
        numbered,
        ["shard"],
        {
            "candidateId": c("candidate_id"),
            "evidenceId": c("evidence_id"),
            "snapshotRef": c("snapshot_ref"),
            "promotedAt": c("promoted_at"),
        },
        link_member="previousRecordSha256",
    )
    linked = history.select(
        "candidate_id",
        "evidence_id",
        c("previous_entry_sha256").alias("previous_record_sha256"),
        c("entry_sha256").alias("record_sha256"),
    )
    attempts = parts["attempts"].select(
        "candidate_id", c("outcome").alias("attempt_outcome"), "failure_code"
    )
    return attempts.join(linked, "candidate_id", "left")


@query(
    f"""WITH {DECIDED_SQL}
    SELECT candidate_id, CASE doc_id % 3 WHEN 0 THEN NULL ELSE 'INVALID_EVIDENCE_ENVELOPE' END AS failure_code
    FROM decided WHERE failure_code IS NULL"""
)
def evidence_binding(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 3`` evidence is unchanged, has another suffix, or lost its candidate."""
    evidence = gate.promotion_record(decided(spark, folder))["evidence"]
    document = F.substring_index("candidate_id", "-", -1).cast("bigint")
    form = F.pmod(document, F.lit(3))
    changed = evidence.withColumn("_form", form).withColumn(
        "suffix", F.when(c("_form") == 1, F.concat("suffix", F.lit("x"))).otherwise(c("suffix"))
    )
    known = candidates(spark, folder).where(F.pmod("doc_id", F.lit(3)) != 2)
    names = [
        "observed_at", "snapshot_ref", "sha256", "byte_length", "exact", "prefix", "suffix", "citation_view",
    ]
    return review.evidence_binding(changed, known, names).select("candidate_id", "failure_code")


def _record_digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshots(spark, folder)
    record = F.struct(
        "media_type", "sha256", "byte_length", "object_path", "source_uri", "captured_at", "available_at"
    )
    return rows.select(
        "doc_id", "snapshot_ref", canonical_digest(snapshot_members(record)).alias("record_digest")
    )


@query(
    """SELECT 'doc:' || doc_id AS snapshot_ref, CASE doc_id % 4 WHEN 1 THEN 'WEB_CAPTURE_RECORD_MISMATCH'
         WHEN 2 THEN 'WEB_CAPTURE_NOT_PERSISTED' END AS failure_code FROM documents"""
)
def record_equality(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("doc_id", F.lit(4))
    rows = _record_digests(spark, folder)
    stored = rows.where(form != 2)
    given = rows.withColumn(
        "record_digest", F.when(form == 1, F.sha2("record_digest", 256)).otherwise(c("record_digest"))
    )
    return cite.record_equality(given, stored, "snapshot_ref", "record_digest").select(
        "snapshot_ref", "failure_code"
    )


@query(
    """SELECT 'doc:' || doc_id AS snapshot_ref, ['identical', 'conflict', 'new'][doc_id % 3 + 1] AS merge
       FROM documents"""
)
def immutable_merge(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("doc_id", F.lit(3))
    rows = _record_digests(spark, folder)
    store = rows.where(form != 2)
    incoming = rows.withColumn(
        "record_digest", F.when(form == 1, F.sha2("record_digest", 256)).otherwise(c("record_digest"))
    )
    return review.immutable_merge(store, incoming, "snapshot_ref", "record_digest").select("snapshot_ref", "merge")


@query(
    f"""WITH {SNAPSHOTS_SQL}
    SELECT sha256, snapshot_ref, row_number() OVER (PARTITION BY sha256 ORDER BY captured_at, snapshot_ref) AS position
    FROM snapshots QUALIFY position <= 100"""
)
def snapshots_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    found = snapshot_ops.snapshots_by_hash(snapshots(spark, folder).drop("content"))
    return found.select("sha256", "snapshot_ref", c("position").cast("bigint").alias("position"))


_SNAPSHOT_JSON = """'{"availableAt":"' || available_at || '","byteLength":' || byte_length || ',"capturedAt":"' ||
      captured_at || '","mediaType":"' || media_type || '","objectPath":"packet:source","sha256":"' || sha256 ||
      '","sourceUri":"urn:quotelock:source:sha256:' || sha256 || '"}'"""
_SELECTOR_JSON = """'{"exact":' || to_json(exact) || ',"prefix":' || to_json(prefix) || ',"suffix":' ||
      to_json(suffix) || ',"type":"TextQuoteSelector"}'"""


@query(
    f"""WITH {DECIDED_SQL}, {_EVIDENCE_SQL}, parts AS (
      SELECT e.*, {_SNAPSHOT_JSON} AS snapshot_json, {_SELECTOR_JSON} AS selector_json,
        to_base64(encode(d.text)) AS base64
      FROM evidence e JOIN documents d ON d.doc_id = e.doc_id)
    SELECT candidate_id, evidence_id, 'urn:quotelock:source:sha256:' || sha256 AS source_uri,
      sha256('{{"assurance":{{"timestamp":"not-attested"}},"candidate":{{"id":"' || candidate_id ||
        '","kind":"EvidenceCandidate","observedAt":"' || observed_at || '","selector":' || selector_json ||
        ',"snapshot":' || snapshot_json || '}},"evidence":{{"candidateId":"' || candidate_id || '","id":"' ||
        evidence_id || '","kind":"VerifiedEvidence","observedAt":"' || observed_at || '","selector":' ||
        selector_json || ',"snapshot":' || snapshot_json || ',"verifiedAt":"' || verified_at ||
        '"}},"kind":"PortableEvidencePacket","source":{{"base64":"' || base64 || '","byteLength":' || byte_length ||
        ',"mediaType":"' || media_type || '","name":"source.bin","sha256":"' || sha256 || '"}},"version":1}}')
        AS packet_sha256, CAST(NULL AS VARCHAR) AS failure_code
    FROM parts"""
)
def packet_export(spark: SparkSession, folder: str) -> DataFrame:
    evidence = gate.promotion_record(decided(spark, folder))["evidence"]
    contents = snapshots(spark, folder).select("snapshot_ref", "content")
    return export.packet_export(evidence, contents).select(
        "candidate_id", "evidence_id", "source_uri", "packet_sha256", "failure_code"
    )


_COMMIT = "0123456789abcdef0123456789abcdef01234567"


@query(
    f"""WITH {DECIDED_SQL}, {_EVIDENCE_SQL}
    SELECT 'evt_' || substr(sha256('promotion:' || evidence_id), 1, 24) AS event_id,
      'edge_' || substr(sha256('derived-from:' || evidence_id || ':artifact:sha256:' || sha256), 1, 24) AS edge_id,
      'artifact:sha256:' || sha256 AS artifact_id, byte_length AS artifact_bytes,
      sha256('{{"availableAt":"' || available_at || '","candidateId":"' || candidate_id || '","evidenceId":"' ||
        evidence_id || '","observedAt":"' || observed_at ||
        '","promotionPolicy":"quotelock/verified-local-citation@1","protocolCommit":"{_COMMIT}","selector":' ||
        {_SELECTOR_JSON} || ',"sourceArtifactId":"artifact:sha256:' || sha256 || '","verifiedAt":"' || verified_at ||
        '"}}') AS payload_sha256
    FROM evidence"""
)
def provenance_export(spark: SparkSession, folder: str) -> DataFrame:
    """The three tables joined back: event, its edge and the artifact."""
    evidence = gate.promotion_record(decided(spark, folder))["evidence"]
    graph = export.provenance_export(evidence, _COMMIT)
    artifacts = graph["artifacts"].select("artifact_id", c("byte_length").alias("artifact_bytes"))
    edges = graph["edges"].select("edge_id", c("promotion_event_ref").alias("event_id"), c("to_ref").alias("artifact_id"))
    return (
        graph["events"]
        .select("event_id", "payload_sha256")
        .join(edges, "event_id")
        .join(artifacts, "artifact_id")
    )


