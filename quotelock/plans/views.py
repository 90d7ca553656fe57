"""Citation records derived from the given tables, in Spark and in SQL.

Every view is a rule on the rows of one table. Faults are derived from keys, so that
each rule of a ladder is broken somewhere and most rows stay clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions.records import object_path
from quotelock.operators.gate import CANDIDATE_KIND, VIEW_TYPE
from quotelock.plans.registry import table
from quotelock.sources.snapshots import TEXT_MEDIA_TYPE

EPOCH_DAY = "2026-01-01"


def iso(seconds: Column) -> Column:
    """Canonical instant that many seconds after 2026-01-01, in any session time zone."""
    day = F.date_add(F.lit(EPOCH_DAY).cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))

    def two(value: Column) -> Column:
        return F.lpad(F.floor(value).cast("string"), 2, "0")

    return F.concat(
        day.cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60),
        F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit(".000Z"),
    )


def iso_sql(seconds: str) -> str:
    return (
        f"strftime(TIMESTAMP '{EPOCH_DAY} 00:00:00' + to_seconds(CAST({seconds} AS BIGINT)), "
        "'%Y-%m-%dT%H:%M:%S.%gZ')"
    )


# -- snapshots and candidates from documents -----------------------------------------


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One snapshot per document; ``content`` is its text."""
    sha = F.sha2("text", 256)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("snapshot_ref"),
        F.lit(TEXT_MEDIA_TYPE).alias("media_type"),
        sha.alias("sha256"),
        F.octet_length("text").cast("bigint").alias("byte_length"),
        object_path(sha).alias("object_path"),
        F.concat(F.lit("file:///corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_uri"),
        iso(F.col("doc_id") + 86400).alias("captured_at"),
        iso(F.col("doc_id")).alias("available_at"),
        F.col("text").alias("content"),
    )


SNAPSHOTS_SQL = f"""snapshots AS (
  SELECT doc_id, 'doc:' || doc_id AS snapshot_ref, '{TEXT_MEDIA_TYPE}' AS media_type,
         sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_length,
         'objects/sha256/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS object_path,
         'file:///corpus/' || doc_id || '.txt' AS source_uri,
         {iso_sql('doc_id + 86400')} AS captured_at, {iso_sql('doc_id')} AS available_at,
         text AS content
  FROM documents)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A quote per document, with a fault by ``doc_id % 20``; short documents are quoted whole."""
    fault = F.pmod(F.col("doc_id"), F.lit(20))

    def faulty(number: int, value: Column, clean: Column) -> Column:
        return F.when(fault == number, value).otherwise(clean)

    c, text = F.col, F.col("content")
    sha = c("sha256")
    short = F.char_length(text) < 80
    exact = F.when(short, text).otherwise(F.substring(text, 10, 60))
    null_view = F.lit(None).cast(VIEW_TYPE)
    view = F.struct(
        F.lit("DerivedCitationView").alias("kind"),
        F.lit("html-text@1").alias("transformation"),
        sha.alias("source_sha256"),
        F.lit(TEXT_MEDIA_TYPE).alias("media_type"),
        sha.alias("sha256"),
        c("byte_length").alias("byte_length"),
    ).cast(VIEW_TYPE)
    return (
        snapshots(spark, folder)
        .select(
            "doc_id",
            F.concat(F.lit("cand-"), c("doc_id").cast("string")).alias("candidate_id"),
            faulty(8, F.lit("VerifiedEvidence"), F.lit(CANDIDATE_KIND)).alias("kind"),
            faulty(5, F.concat(F.lit("gone:"), c("doc_id").cast("string")), c("snapshot_ref")).alias("snapshot_ref"),
            "media_type",
            F.when(fault == 1, F.concat(F.substring(sha, 2, 63), F.substring(sha, 1, 1)))
            .when(fault == 13, F.upper(sha))
            .otherwise(sha)
            .alias("sha256"),
            faulty(2, c("byte_length") + 1, c("byte_length")).alias("byte_length"),
            "object_path",
            "source_uri",
            F.when(fault == 4, iso(c("doc_id") - 86400))
            .when(fault == 11, F.lit("2026-02-31T00:00:00.000Z"))
            .otherwise(c("captured_at"))
            .alias("captured_at"),
            faulty(10, F.substring("available_at", 1, 10), c("available_at")).alias("available_at"),
            F.lit("TextQuoteSelector").alias("selector_type"),
            F.when(fault == 6, F.concat(exact, F.lit("¤")))
            .when(fault == 9, F.lit(""))
            .when(fault == 14, F.lit(" "))
            .otherwise(exact)
            .alias("exact"),
            F.when(fault == 3, F.substring(text, 2, 8))
            .when(fault == 12, F.substring(text, 1, 33))
            .otherwise(F.when(short, F.lit("")).otherwise(F.substring(text, 1, 9)))
            .alias("prefix"),
            F.when(short, F.lit("")).otherwise(F.substring(text, 70, 32)).alias("suffix"),
            faulty(15, view, null_view).alias("citation_view"),
            c("captured_at").alias("observed_at"),
            faulty(7, iso(c("doc_id")), iso(c("doc_id") + 172800)).alias("verified_at"),
        )
    )


CANDIDATES_SQL = f"""{SNAPSHOTS_SQL}, candidates AS (
  SELECT doc_id, 'cand-' || doc_id AS candidate_id,
         CASE doc_id % 20 WHEN 8 THEN 'VerifiedEvidence' ELSE 'EvidenceCandidate' END AS kind,
         CASE doc_id % 20 WHEN 5 THEN 'gone:' || doc_id ELSE snapshot_ref END AS snapshot_ref,
         media_type,
         CASE doc_id % 20 WHEN 1 THEN substr(sha256, 2) || substr(sha256, 1, 1)
              WHEN 13 THEN upper(sha256) ELSE sha256 END AS sha256,
         CASE doc_id % 20 WHEN 2 THEN byte_length + 1 ELSE byte_length END AS byte_length,
         object_path, source_uri,
         CASE doc_id % 20 WHEN 4 THEN {iso_sql('doc_id - 86400')}
              WHEN 11 THEN '2026-02-31T00:00:00.000Z' ELSE captured_at END AS captured_at,
         CASE doc_id % 20 WHEN 10 THEN substr(available_at, 1, 10) ELSE available_at END AS available_at,
         CASE doc_id % 20 WHEN 6 THEN quote || '¤' WHEN 9 THEN '' WHEN 14 THEN ' ' ELSE quote END AS exact,
         CASE WHEN doc_id % 20 = 3 THEN substr(content, 2, 8) WHEN doc_id % 20 = 12 THEN substr(content, 1, 33)
              WHEN length(content) < 80 THEN '' ELSE substr(content, 1, 9) END AS prefix,
         CASE WHEN length(content) < 80 THEN '' ELSE substr(content, 70, 32) END AS suffix,
         doc_id % 20 = 15 AS has_view,
         captured_at AS observed_at,
         CASE doc_id % 20 WHEN 7 THEN {iso_sql('doc_id')} ELSE {iso_sql('doc_id + 172800')} END AS verified_at
  FROM (SELECT *, CASE WHEN length(content) < 80 THEN content ELSE substr(content, 10, 60) END AS quote FROM snapshots))"""


def _full_instant(name: str) -> str:
    return f"(length({name}) > 10 AND try_cast({name} AS TIMESTAMP) IS NOT NULL)"


ENVELOPE_CASES = f"""
      WHEN c.kind <> 'EvidenceCandidate' THEN 'INVALID_EVIDENCE_ENVELOPE'
      WHEN NOT regexp_full_match(c.sha256, '[0-9a-f]{{64}}') THEN 'INVALID_EVIDENCE_ENVELOPE'
      WHEN NOT {_full_instant('c.captured_at')} THEN 'INVALID_TIMESTAMP'
      WHEN NOT {_full_instant('c.available_at')} THEN 'INVALID_TIMESTAMP'
      WHEN c.exact = '' THEN 'INVALID_EVIDENCE_ENVELOPE'
      WHEN length(c.prefix) > 32 OR length(c.suffix) > 32 THEN 'INVALID_EVIDENCE_ENVELOPE'
      WHEN CAST(c.available_at AS TIMESTAMP) > CAST(c.captured_at AS TIMESTAMP)
        OR CAST(c.captured_at AS TIMESTAMP) > CAST(c.observed_at AS TIMESTAMP) THEN 'TIMESTAMP_ORDER_INVALID'
      WHEN c.has_view THEN 'CITATION_VIEW_INVALID'"""

INTEGRITY_CASES = """
      WHEN s.snapshot_ref IS NULL THEN 'SNAPSHOT_MISSING'
      WHEN s.byte_length <> c.byte_length THEN 'SNAPSHOT_SIZE_MISMATCH'
      WHEN s.sha256 <> c.sha256 THEN 'SNAPSHOT_HASH_MISMATCH'"""

SELECTOR_CASES = """
      WHEN c.exact = '' OR strpos(s.content, c.exact) = 0 THEN 'SELECTOR_NOT_FOUND'
      WHEN strpos(substr(s.content, strpos(s.content, c.exact) + 1), c.exact) > 0 THEN 'SELECTOR_AMBIGUOUS'
      WHEN c.prefix <> substr(s.content, greatest(1, strpos(s.content, c.exact) - 32),
             strpos(s.content, c.exact) - greatest(1, strpos(s.content, c.exact) - 32))
        OR c.suffix <> substr(s.content, strpos(s.content, c.exact) + length(c.exact), 32)
        THEN 'SELECTOR_CONTEXT_MISMATCH'"""

DECIDED_SQL = f"""{CANDIDATES_SQL}, decided AS (
  SELECT c.*, CASE
      WHEN c.kind <> 'EvidenceCandidate' THEN 'INVALID_CANDIDATE_KIND'
      WHEN c.exact = '' THEN 'SELECTOR_NOT_FOUND'{ENVELOPE_CASES}
      WHEN CAST(c.observed_at AS TIMESTAMP) > CAST(c.verified_at AS TIMESTAMP)
        THEN 'VERIFICATION_TIME_INVALID'{INTEGRITY_CASES}{SELECTOR_CASES}
      END AS failure_code
  FROM candidates c LEFT JOIN snapshots s ON s.snapshot_ref = c.snapshot_ref)"""


def decided(spark: SparkSession, folder: str) -> DataFrame:
    from quotelock.operators.gate import promotion_gate

    return promotion_gate(
        candidates(spark, folder), snapshots(spark, folder).select("snapshot_ref", "content")
    )


# -- attempts from events --------------------------------------------------------------


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Promotion attempts: purchases verify, all else rejects; the user is the candidate."""
    kind = F.col("event_type")
    return (
        table(spark, folder, "events")
        .select(
            F.concat(F.lit("cand-"), F.col("user_id").cast("string")).alias("candidate_id"),
            F.col("event_id").alias("sequence"),
            F.when(kind == "purchase", "verified").otherwise("rejected").alias("outcome"),
            F.when(kind == "purchase", None)
            .when(kind == "error", "SELECTOR_NOT_FOUND")
            .otherwise("SNAPSHOT_MISSING")
            .alias("failure_code"),
        )
    )


ATTEMPTS_SQL = """attempts AS (
  SELECT 'cand-' || user_id AS candidate_id, event_id AS sequence,
         CASE event_type WHEN 'purchase' THEN 'verified' ELSE 'rejected' END AS outcome,
         CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN 'SELECTOR_NOT_FOUND' ELSE 'SNAPSHOT_MISSING' END
           AS failure_code
  FROM events)"""


# -- packet chains from conversations ----------------------------------------------------


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """One packet per turn; a conversation is a collection."""
    key = F.concat_ws("-", "conv_id", "turn")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("collection_id"),
        (F.col("turn") + 1).cast("bigint").alias("sequence"),
        F.sha2(F.concat(F.lit("packet:"), key, F.lit(":"), F.col("text")), 256).alias("packet_sha256"),
        F.sha2("text", 256).alias("source_sha256"),
        F.octet_length("text").cast("bigint").alias("source_byte_length"),
        F.concat(F.lit("cand-"), key).alias("candidate_id"),
        F.concat(F.lit("ev-"), key).alias("evidence_id"),
    )


PACKETS_SQL = """packets AS (
  SELECT conv_id AS collection_id, CAST(turn + 1 AS BIGINT) AS sequence,
         sha256('packet:' || conv_id || '-' || turn || ':' || text) AS packet_sha256,
         sha256(text) AS source_sha256, CAST(strlen(text) AS BIGINT) AS source_byte_length,
         'cand-' || conv_id || '-' || turn AS candidate_id, 'ev-' || conv_id || '-' || turn AS evidence_id
  FROM conversations)"""


def packet_entry_sql(previous: str, alias: str = "p") -> str:
    """Entry digest in SQL over one packet row and its link expression."""
    a = alias
    return (
        f"sha256('{{\"candidateId\":\"' || {a}.candidate_id || '\",\"evidenceId\":\"' || {a}.evidence_id "
        f"|| '\",\"packetSha256\":\"' || {a}.packet_sha256 || '\",\"previousEntrySha256\":' || "
        f"coalesce('\"' || {previous} || '\"', 'null') || ',\"sequence\":' || {a}.sequence || "
        f"',\"sourceByteLength\":' || {a}.source_byte_length || ',\"sourceSha256\":\"' || "
        f"{a}.source_sha256 || '\"}}')"
    )


ENTRIES_SQL = f"""{PACKETS_SQL}, entries AS (
  SELECT p.*, CAST(NULL AS VARCHAR) AS previous_entry_sha256,
         {packet_entry_sql('CAST(NULL AS VARCHAR)')} AS entry_sha256
  FROM packets p WHERE p.sequence = 1
  UNION ALL
  SELECT p.*, e.entry_sha256, {packet_entry_sql('e.entry_sha256')}
  FROM packets p JOIN entries e ON p.collection_id = e.collection_id AND p.sequence = e.sequence + 1)"""


def entries(spark: SparkSession, folder: str) -> DataFrame:
    from quotelock.operators.chains import chain_build
    from quotelock.operators.lineage import packet_payload

    return chain_build(packets(spark, folder), ["collection_id"], packet_payload())


def tampered(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with faults by ``collection_id % 7``: payload, link, gap and repeat."""
    rows = entries(spark, folder)
    kind, at = F.pmod("collection_id", F.lit(7)), F.col("sequence")
    changed = (
        rows.withColumn(
            "source_byte_length",
            F.when((kind == 3) & (at == 2), F.col("source_byte_length") + 1).otherwise(F.col("source_byte_length")),
        )
        .withColumn(
            "previous_entry_sha256",
            F.when((kind == 4) & (at == 2), F.sha2("packet_sha256", 256)).otherwise(F.col("previous_entry_sha256")),
        )
        .where(~((kind == 5) & (at == 2)))
    )
    copies = F.when((kind == 6) & (at == 2), 2).otherwise(1)
    return changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


TAMPERED_SQL = f"""{ENTRIES_SQL}, tampered AS (
  SELECT collection_id, sequence, packet_sha256, source_sha256,
         CASE WHEN collection_id % 7 = 3 AND sequence = 2 THEN source_byte_length + 1
              ELSE source_byte_length END AS source_byte_length,
         candidate_id, evidence_id,
         CASE WHEN collection_id % 7 = 4 AND sequence = 2 THEN sha256(packet_sha256)
              ELSE previous_entry_sha256 END AS previous_entry_sha256,
         entry_sha256
  FROM entries, unnest(range(CASE WHEN collection_id % 7 = 6 AND sequence = 2 THEN 2 ELSE 1 END))
  WHERE NOT (collection_id % 7 = 5 AND sequence = 2))"""


def supplied(spark: SparkSession, folder: str) -> DataFrame:
    """Packets handed in for audit, with faults by ``collection_id % 6``.

    1: the second is missing, 2: the first two are swapped, 3: the second is repeated in
    place of the third, 4: the second is foreign, 5: the second has other metadata.
    """
    rows = packets(spark, folder)
    kind, at = F.pmod("collection_id", F.lit(6)), F.col("sequence")
    position = (
        F.when((kind == 2) & (at <= 2), 3 - at)
        .when((kind == 1) & (at > 2), at - 1)
        .otherwise(at)
        .cast("bigint")
    )
    repeat = (kind == 3) & (at == 2)
    copies = F.when(repeat, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0)))
    return (
        rows.where(~((kind == 1) & (at == 2)) & ~((kind == 3) & (at == 3)))
        .withColumn("_place", F.explode(copies))
        .select(
            "collection_id",
            F.when(F.col("_place") > 0, F.col("_place").cast("bigint")).otherwise(position).alias("position"),
            F.when((kind == 4) & (at == 2), F.sha2("packet_sha256", 256))
            .otherwise(F.col("packet_sha256"))
            .alias("packet_sha256"),
            "source_sha256",
            "source_byte_length",
            F.when((kind == 5) & (at == 2), F.concat("candidate_id", F.lit("-x")))
            .otherwise(F.col("candidate_id"))
            .alias("candidate_id"),
            "evidence_id",
        )
    )


SUPPLIED_SQL = """supplied AS (
  SELECT collection_id,
         CAST(CASE WHEN place > 0 THEN place
              WHEN collection_id % 6 = 2 AND sequence <= 2 THEN 3 - sequence
              WHEN collection_id % 6 = 1 AND sequence > 2 THEN sequence - 1
              ELSE sequence END AS BIGINT) AS position,
         CASE WHEN collection_id % 6 = 4 AND sequence = 2 THEN sha256(packet_sha256)
              ELSE packet_sha256 END AS packet_sha256,
         source_sha256, source_byte_length,
         CASE WHEN collection_id % 6 = 5 AND sequence = 2 THEN candidate_id || '-x'
              ELSE candidate_id END AS candidate_id,
         evidence_id
  FROM packets, unnest(CASE WHEN collection_id % 6 = 3 AND sequence = 2 THEN [2, 3] ELSE [0] END) AS t(place)
  WHERE NOT (collection_id % 6 = 1 AND sequence = 2) AND NOT (collection_id % 6 = 3 AND sequence = 3))"""


# -- releases and upgrades from orders -----------------------------------------------------


def version_of(key: Column) -> Column:
    """Semantic version spelled by an integer key; every third is a prerelease."""
    core = F.concat_ws(
        ".",
        F.floor(key / 1000).cast("string"),
        F.pmod(F.floor(key / 10), F.lit(100)).cast("string"),
        F.pmod(key, F.lit(10)).cast("string"),
    )
    return F.when(
        F.pmod(key, F.lit(3)) == 0,
        F.concat(core, F.lit("-rc."), F.pmod(key, F.lit(12)).cast("string")),
    ).otherwise(core)


def version_sql(key: str) -> str:
    return (
        f"(({key}) // 1000) || '.' || ((({key}) // 10) % 100) || '.' || (({key}) % 10) || "
        f"CASE WHEN ({key}) % 3 = 0 THEN '-rc.' || (({key}) % 12) ELSE '' END"
    )


def release_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders, in key order, are the releases of one product: their keys and numbers.

    Releases are numbered by counting keys per customer and year in two steps, so no
    customer is sorted in one task.
    """
    from quotelock.plans.blocks import running_sum

    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("release_key")
    )
    numbered = running_sum(orders, ["product_id"], "release_key", F.lit(1), "sequence")
    return numbered.select("product_id", F.col("sequence").cast("bigint").alias("sequence"), "release_key")


def head_of(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")), 256)


def releases(spark: SparkSession, folder: str) -> DataFrame:
    """The releases of :func:`release_numbers` with the heads of their artifacts."""

    def head(kind: str) -> Column:
        return head_of(kind, F.col("release_key"))

    return release_numbers(spark, folder).select(
        "product_id",
        "sequence",
        "release_key",
        version_of(F.col("release_key")).alias("release_version"),
        head("pack").alias("pack_sha256"),
        head("package").alias("package_sha256"),
        head("statement").alias("statement_sha256"),
        F.substring(head("revision"), 1, 40).alias("revision"),
        head("bundle").alias("bundle_sha256"),
        head("manifest").alias("manifest_sha256"),
        head("receipt").alias("receipt_sha256"),
        F.when(F.pmod("release_key", F.lit(3)) == 0, "rotation-history").otherwise("manual").alias("trust_mode"),
        (F.pmod("release_key", F.lit(4)) + 1).alias("verified_signer_count"),
    )


RELEASES_SQL = f"""releases AS (
  SELECT o_custkey AS product_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence,
         o_orderkey AS release_key, {version_sql('o_orderkey')} AS release_version,
         sha256('pack:' || o_orderkey) AS pack_sha256, sha256('package:' || o_orderkey) AS package_sha256,
         sha256('statement:' || o_orderkey) AS statement_sha256,
         substr(sha256('revision:' || o_orderkey), 1, 40) AS revision,
         sha256('bundle:' || o_orderkey) AS bundle_sha256, sha256('manifest:' || o_orderkey) AS manifest_sha256,
         sha256('receipt:' || o_orderkey) AS receipt_sha256,
         CASE WHEN o_orderkey % 3 = 0 THEN 'rotation-history' ELSE 'manual' END AS trust_mode,
         o_orderkey % 4 + 1 AS verified_signer_count
  FROM orders)"""


def upgrades(spark: SparkSession, folder: str) -> DataFrame:
    """One upgrade per adjacent pair of a product's releases.

    The neighbour is found on narrow rows; versions and heads of both are made behind the join.
    """
    from quotelock.plans.blocks import with_previous

    paired = with_previous(
        release_numbers(spark, folder), ["product_id"], "sequence", {"key": F.col("release_key")}
    ).where(F.col("sequence") > 1)
    key, known = F.col("release_key"), F.col("previous").isNotNull()
    before = F.col("previous")["key"]
    return paired.select(
        "product_id",
        (F.col("sequence") - 1).alias("sequence"),
        F.when(known, version_of(before)).alias("previous_package_version"),
        version_of(key).alias("current_package_version"),
        F.when(known, head_of("pack", before)).alias("previous_pack_sha256"),
        head_of("pack", key).alias("current_pack_sha256"),
        head_of("upgrade", key).alias("upgrade_evidence_sha256"),
        head_of("binding", key).alias("binding_sha256"),
        "release_key",
    )


UPGRADES_SQL = f"""{RELEASES_SQL}, upgrades AS (
  SELECT product_id, sequence - 1 AS sequence, previous_package_version,
         release_version AS current_package_version, previous_pack_sha256, pack_sha256 AS current_pack_sha256,
         sha256('upgrade:' || release_key) AS upgrade_evidence_sha256,
         sha256('binding:' || release_key) AS binding_sha256, release_key
  FROM (SELECT *, lag(release_version) OVER w AS previous_package_version,
               lag(pack_sha256) OVER w AS previous_pack_sha256
        FROM releases WINDOW w AS (PARTITION BY product_id ORDER BY sequence))
  WHERE sequence > 1)"""


# -- HTML pages -------------------------------------------------------------------------


def page_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("snapshot_ref"),
        F.sha2("html", 256).alias("sha256"),
        F.col("html").alias("content"),
    )


_BLOCKS = (
    "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|"
    "header|li|main|nav|ol|p|pre|section|table|tbody|tfoot|thead|tr|ul"
)


def _nested_replace(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement}', 'g')"
    return expression


_MARKED = _nested_replace(
    "html",
    [
        ("(?s)<head>.*?</head>", ""),
        ("(?s)<!--.*?-->", ""),
        ("(?s)<(script|style|noscript|template)\\b[^>]*>.*?</(script|style|noscript|template)>", ""),
        ("<!DOCTYPE[^>]*>", ""),
        ("<(br|hr)\\b[^>]*>", "\x01"),
        (f"</?({_BLOCKS})(\\s[^>]*)?>", "\x01"),
        ("</(td|th)>", "\x02"),
        ("<[^>]*>", ""),
        ("\x01+", "\n"),
        ("\x02+", "\t"),
    ],
)
_DECODED = (
    f"replace(replace(replace(replace(replace(replace({_MARKED}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
    "'&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
)
PAGE_TEXT_SQL = "trim({}, ' ' || chr(9) || chr(10))".format(
    _nested_replace(_DECODED, [("[\t\x0c\x0b  ]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")])
)
PAGE_VIEWS_SQL = f"""page_views AS (
  SELECT page_id, 'page:' || page_id AS snapshot_ref, sha256(html) AS source_sha256, view_text,
         sha256(view_text) AS view_sha256, CAST(strlen(view_text) AS BIGINT) AS view_byte_length
  FROM (SELECT *, {PAGE_TEXT_SQL} AS view_text FROM pages))"""
