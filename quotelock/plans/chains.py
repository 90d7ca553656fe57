"""Hash-chain queries over collections made from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest
from quotelock.functions.semver import semver_key
from quotelock.operators import chains, export
from quotelock.operators.lineage import packet_payload, transitions_of
from quotelock.plans.registry import query
from quotelock.plans.views import (
    ENTRIES_SQL,
    PACKETS_SQL,
    RELEASES_SQL,
    TAMPERED_SQL,
    entries,
    packet_entry_sql,
    packets,
    releases,
    tampered,
)

c = F.col
COLLECTION = ["collection_id"]


@query(
    f"""WITH RECURSIVE {ENTRIES_SQL}
    SELECT collection_id, sequence, previous_entry_sha256, entry_sha256 FROM entries"""
)
def chain_build(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select(
        "collection_id", "sequence", "previous_entry_sha256", "entry_sha256"
    )


@query(
    f"""WITH RECURSIVE {TAMPERED_SQL}, copies AS (
      SELECT collection_id, sequence, count(*) AS copies, max(entry_sha256) AS entry_sha256,
        max(previous_entry_sha256) AS link, min({packet_entry_sql('t.previous_entry_sha256', 't')} = entry_sha256)
          AS intact FROM tampered t GROUP BY 1, 2), linked AS (
      SELECT *, lag(sequence) OVER w AS before, lag(entry_sha256) OVER w AS expected FROM copies
      WINDOW w AS (PARTITION BY collection_id ORDER BY sequence)), coded AS (
      SELECT *, CASE WHEN copies > 1 THEN 'SEQUENCE_DUPLICATE'
        WHEN sequence > 1 AND before IS DISTINCT FROM sequence - 1 THEN 'SEQUENCE_GAP'
        WHEN link IS DISTINCT FROM expected THEN 'LINK_MISMATCH' WHEN NOT intact THEN 'HASH_MISMATCH' END AS code
      FROM linked)
    SELECT collection_id, CAST(sum(copies) AS BIGINT) AS entries, arg_max(entry_sha256, sequence) AS head_sha256,
      min(sequence) FILTER (code IS NOT NULL) AS first_broken_sequence,
      arg_min(code, sequence) FILTER (code IS NOT NULL) AS failure_code
    FROM coded GROUP BY collection_id"""
)
def chain_verify(spark: SparkSession, folder: str) -> DataFrame:
    return chains.chain_verify(tampered(spark, folder), COLLECTION, packet_payload())


@query(
    f"""WITH RECURSIVE {TAMPERED_SQL}, listed AS (
      SELECT collection_id, unnest(['packet_sha256', 'candidate_id', 'evidence_id']) AS identity,
        unnest([packet_sha256, candidate_id, evidence_id]) AS value FROM tampered)
    SELECT collection_id, identity, value, count(*) AS copies FROM listed GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def duplicate_identities(spark: SparkSession, folder: str) -> DataFrame:
    return chains.duplicate_identities(
        tampered(spark, folder), COLLECTION, ["packet_sha256", "candidate_id", "evidence_id"]
    )


@query(
    f"""WITH {PACKETS_SQL}, summed AS (
      SELECT collection_id, sequence, CAST(sum(source_byte_length) OVER (PARTITION BY collection_id ORDER BY sequence)
        AS BIGINT) AS total_bytes FROM packets)
    SELECT *, CAST(NULL AS VARCHAR) AS failure_code FROM summed"""
)
def running_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return chains.running_bytes(packets(spark, folder), COLLECTION).select(
        "collection_id", "sequence", c("total_bytes").cast("bigint").alias("total_bytes"), "failure_code"
    )


@query(
    f"""WITH {PACKETS_SQL}
    SELECT collection_id, count(*) AS packet_count, CAST(sum(source_byte_length) AS BIGINT) AS total_source_bytes,
      arg_min(packet_sha256, sequence) AS first_packet_sha256, arg_max(packet_sha256, sequence) AS last_packet_sha256
    FROM packets GROUP BY collection_id"""
)
def collection_totals(spark: SparkSession, folder: str) -> DataFrame:
    return chains.collection_totals(packets(spark, folder), COLLECTION)


@query(
    f"""WITH {RELEASES_SQL}, keyed AS (
      SELECT product_id, sequence, release_version, [CAST(k // 1000 AS BIGINT), (k // 10) % 100, k % 10,
          CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN k % 3 = 0 THEN k % 12 ELSE 0 END] AS key
      FROM (SELECT *, CASE WHEN release_key % 11 = 4 THEN release_key % 100 ELSE release_key END AS k FROM releases))
    SELECT product_id, CASE WHEN product_id % 9 <> 4 OR sequence <> 2 THEN sequence END AS sequence,
      CASE WHEN product_id % 9 = 4 AND sequence = 2 THEN 'SEQUENCE_GAP'
        WHEN product_id % 9 = 5 AND sequence = 2 THEN 'SEQUENCE_DUPLICATE'
        WHEN product_id % 9 IN (3, 4, 5) AND sequence = 3 THEN 'SEQUENCE_GAP'
        WHEN lag(key) OVER w >= key THEN 'VERSION_NOT_INCREASING' END AS failure_code
    FROM keyed, unnest(range(CASE WHEN product_id % 9 = 5 AND sequence = 2 THEN 2 ELSE 1 END))
    WHERE NOT (product_id % 9 = 3 AND sequence = 2)
    WINDOW w AS (PARTITION BY product_id ORDER BY sequence)"""
)
def strictly_increasing(spark: SparkSession, folder: str) -> DataFrame:
    """Every eleventh release repeats a low version number.

    By ``product_id % 9`` the second release is 3 missing, 4 without its place, 5 there twice.
    """
    from quotelock.plans.views import version_of

    low = F.when(F.pmod("release_key", F.lit(11)) == 4, F.pmod("release_key", F.lit(100))).otherwise(c("release_key"))
    rows = releases(spark, folder).select("product_id", "sequence", version_of(low).alias("version"))
    form, second = F.pmod("product_id", F.lit(9)), c("sequence") == 2
    faulty = (
        rows.where(~((form == 3) & second))
        .withColumn("_copies", F.when((form == 5) & second, 2).otherwise(1))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .withColumn("sequence", F.when(~((form == 4) & second), c("sequence")))
    )
    return chains.strictly_increasing(faulty, ["product_id"], semver_key(c("version"))).select(
        "product_id", "sequence", "failure_code"
    )


# -- transition histories -------------------------------------------------------------

_PLAIN = '"assurance":{"timestamp":"not-attested"}'

HEADS_SQL = f"""{ENTRIES_SQL}, items AS (
  SELECT *, '{{"candidateId":"' || candidate_id || '","entrySha256":"' || entry_sha256 || '","evidenceId":"' || evidence_id ||
      '","packetSha256":"' || packet_sha256 || '","previousEntrySha256":' || coalesce('"' || previous_entry_sha256 || '"', 'null') ||
      ',"sequence":' || sequence || ',"sourceByteLength":' || source_byte_length || ',"sourceSha256":"' || source_sha256 || '"}}' AS item,
    '{{"name":"packets/' || packet_sha256 || '.json","packetSha256":"' || packet_sha256 || '","sourceByteLength":' ||
      source_byte_length || ',"sourceSha256":"' || source_sha256 || '"}}' AS packet FROM entries), prefixes AS (
  SELECT *, string_agg(item, ',') OVER w AS items, string_agg(packet, ',') OVER w AS packets_text,
    sum(source_byte_length) OVER w AS total, first_value(packet_sha256) OVER w AS first_packet
  FROM items WINDOW w AS (PARTITION BY collection_id ORDER BY sequence)), headed AS (
  SELECT *, sha256('{{{_PLAIN},"entries":[' || items || '],"kind":"QuotelockEvidencePacketIndex","version":1}}') AS index_sha256,
    sha256('[' || packets_text || ']') AS packets_sha256 FROM prefixes), audited AS (
  SELECT *, sha256('{{{_PLAIN},"coverage":{{"firstPacketSha256":"' || first_packet || '","lastPacketSha256":"' || packet_sha256 ||
      '","totalSourceBytes":' || total || '}},"index":{{"indexSha256":"' || index_sha256 || '","packetCount":' || sequence ||
      '}},"kind":"QuotelockEvidencePacketCollectionAuditReceipt","outcome":"verified","version":1}}') AS audit_sha256
  FROM headed), bundled AS (
  SELECT *, sha256('{{{_PLAIN},"auditSha256":"' || audit_sha256 || '","indexSha256":"' || index_sha256 ||
      '","kind":"QuotelockEvidencePacketCollectionBundle","packetsSha256":"' || packets_sha256 || '","version":1}}') AS bundle_sha256
  FROM audited)"""


def receipt_sql(first_packet: str, last_packet: str) -> str:
    """Digest in SQL of the receipt of a row with heads and counts of both sides."""
    return (
        f"sha256('{{{{\"append\":{{{{\"firstPacketSha256\":\"' || {first_packet} || '\",\"firstSequence\":' || (previous_packet_count + 1) ||"
        f" ',\"lastPacketSha256\":\"' || {last_packet} || '\",\"lastSequence\":' || next_packet_count || ',\"packetCount\":' ||"
        " (next_packet_count - previous_packet_count) || '}},\"assurance\":{{\"timestamp\":\"not-attested\"}},\"kind\":\"QuotelockEvidencePacketCollectionTransitionAuditReceipt\","
        "\"next\":{{\"bundleSha256\":\"' || next_bundle_sha256 || '\",\"indexSha256\":\"' || next_index_sha256 || '\",\"packetCount\":' || next_packet_count ||"
        " '}},\"outcome\":\"verified\",\"previous\":{{\"bundleSha256\":\"' || previous_bundle_sha256 || '\",\"indexSha256\":\"' ||"
        " previous_index_sha256 || '\",\"packetCount\":' || previous_packet_count || '}},\"version\":1}}')"
    ).replace("{{", "{").replace("}}", "}")


def history_entry_sql(previous: str, row: str = "r") -> str:
    """Digest in SQL of a history entry over its link expression."""
    text = lambda name: f"\"' || {row}.{name} || '\""
    return (
        f"sha256('{{\"appendedPacketCount\":' || ({row}.next_packet_count - {row}.previous_packet_count) || ',\"nextBundleSha256\":{text('next_bundle_sha256')},"
        f"\"nextIndexSha256\":{text('next_index_sha256')},\"nextPacketCount\":' || {row}.next_packet_count || ',\"previousBundleSha256\":"
        f"{text('previous_bundle_sha256')},\"previousEntrySha256\":' || coalesce('\"' || {previous} || '\"', 'null') || ',\"previousIndexSha256\":"
        f"{text('previous_index_sha256')},\"previousPacketCount\":' || {row}.previous_packet_count || ',\"sequence\":' || {row}.sequence ||"
        f" ',\"transitionAuditSha256\":{text('transition_audit_sha256')}}}')"
    )


TRANSITIONS_SQL = f"""{HEADS_SQL}, transitions AS (
  SELECT e.collection_id, e.sequence - 1 AS sequence, p.bundle_sha256 AS previous_bundle_sha256,
    e.bundle_sha256 AS next_bundle_sha256, p.index_sha256 AS previous_index_sha256,
    e.index_sha256 AS next_index_sha256, e.sequence - 1 AS previous_packet_count, e.sequence AS next_packet_count,
    e.packet_sha256
  FROM bundled e JOIN bundled p ON p.collection_id = e.collection_id AND p.sequence = e.sequence - 1), receipts AS (
  SELECT *, {receipt_sql('packet_sha256', 'packet_sha256')} AS transition_audit_sha256 FROM transitions)"""

HISTORY_SQL = f"""{TRANSITIONS_SQL}, history AS (
  SELECT r.*, CAST(NULL AS VARCHAR) AS link, {history_entry_sql('CAST(NULL AS VARCHAR)')} AS entry
  FROM receipts r WHERE sequence = 1
  UNION ALL
  SELECT r.*, h.entry, {history_entry_sql('h.entry')}
  FROM receipts r JOIN history h ON r.collection_id = h.collection_id AND r.sequence = h.sequence + 1)"""


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    return transitions_of(entries(spark, folder), COLLECTION)


@query(
    f"""WITH RECURSIVE {TRANSITIONS_SQL}
    SELECT collection_id, count(*) AS transition_count,
      arg_min(previous_bundle_sha256, sequence) AS initial_bundle_sha256,
      arg_max(next_bundle_sha256, sequence) AS latest_bundle_sha256,
      arg_min(previous_packet_count, sequence) AS initial_packet_count,
      arg_max(next_packet_count, sequence) AS latest_packet_count,
      arg_min(transition_audit_sha256, sequence) AS first_transition_audit_sha256,
      arg_max(transition_audit_sha256, sequence) AS last_transition_audit_sha256
    FROM receipts GROUP BY collection_id"""
)
def history_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return chains.history_coverage(transitions(spark, folder), COLLECTION)


@query(
    f"""WITH RECURSIVE {TRANSITIONS_SQL}, faulty AS (
      SELECT collection_id, sequence,
        CASE WHEN collection_id % 5 = 1 AND sequence = 2 THEN sha256(previous_bundle_sha256)
          ELSE previous_bundle_sha256 END AS previous_bundle_sha256,
        CASE WHEN collection_id % 5 = 2 AND sequence = 2 THEN previous_bundle_sha256 ELSE next_bundle_sha256
          END AS next_bundle_sha256,
        CASE WHEN collection_id % 5 = 3 AND sequence = 2 THEN previous_packet_count + 1 ELSE previous_packet_count
          END AS previous_packet_count, next_packet_count
      FROM receipts WHERE NOT (collection_id % 5 = 4 AND sequence = 2)),
    faulted AS (SELECT * FROM faulty UNION ALL
      SELECT collection_id, sequence, previous_bundle_sha256, sha256('fork:' || next_bundle_sha256),
        previous_packet_count, next_packet_count FROM faulty WHERE collection_id % 10 = 5 AND sequence = 2)
    SELECT collection_id, sequence, CASE
      WHEN sequence > min(sequence) OVER (PARTITION BY collection_id, next_bundle_sha256) THEN 'HISTORY_DUPLICATE'
      WHEN count(*) OVER (PARTITION BY collection_id, sequence) > 1 THEN 'HISTORY_FORK'
      WHEN sequence = 1 THEN NULL
      WHEN lag(sequence) OVER w IS DISTINCT FROM sequence - 1 OR (collection_id % 10 = 5 AND sequence = 3)
        THEN 'HISTORY_GAP'
      WHEN previous_bundle_sha256 <> lag(next_bundle_sha256) OVER w
        OR previous_packet_count <> lag(next_packet_count) OVER w THEN 'HISTORY_CONTINUITY_MISMATCH' END AS failure_code
    FROM faulted WINDOW w AS (PARTITION BY collection_id ORDER BY sequence)"""
)
def history_continuity(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 5``: 1 other start, 2 repeated head, 3 other count, 4 gap, at entry 2;
    of every second 0, a fork there."""
    form, second = F.pmod("collection_id", F.lit(5)), c("sequence") == 2
    faulty = (
        transitions(spark, folder)
        .where(~((form == 4) & second))
        .withColumn("_old", c("previous_bundle_sha256"))
        .withColumns(
            {
                "previous_bundle_sha256": F.when((form == 1) & second, F.sha2("_old", 256)).otherwise(c("_old")),
                "next_bundle_sha256": F.when((form == 2) & second, c("_old")).otherwise(c("next_bundle_sha256")),
                "previous_packet_count": F.when(
                    (form == 3) & second, c("previous_packet_count") + 1
                ).otherwise(c("previous_packet_count")),
            }
        )
    )
    fork = (F.pmod("collection_id", F.lit(10)) == 5) & second
    forked = faulty.where(fork).withColumn("next_bundle_sha256", F.sha2(F.concat(F.lit("fork:"), "next_bundle_sha256"), 256))
    faulty = faulty.unionByName(forked)
    return chains.history_continuity(
        faulty,
        COLLECTION,
        {"previous_bundle_sha256": "next_bundle_sha256", "previous_packet_count": "next_packet_count"},
    ).select("collection_id", "sequence", "failure_code")


@query(
    f"""WITH {PACKETS_SQL}, previous AS (SELECT * FROM packets WHERE sequence <= 2), following AS (
      SELECT collection_id, sequence, packet_sha256, CASE WHEN collection_id % 4 = 1 AND sequence = 1
          THEN source_byte_length + 1 ELSE source_byte_length END AS size
      FROM packets WHERE NOT (collection_id % 4 = 2 AND sequence > 2) AND NOT (collection_id % 4 = 3 AND sequence = 3)),
    sides AS (SELECT collection_id, sequence, packet_sha256, source_byte_length AS old, CAST(NULL AS BIGINT) AS new,
        1 AS b, 0 AS a FROM previous UNION ALL
      SELECT collection_id, sequence, packet_sha256, NULL, size, 0, 1 FROM following),
    positions AS (SELECT collection_id, sequence, sum(b) AS b, sum(a) AS a, max(old) AS old, max(new) AS new,
        max(packet_sha256) AS head FROM sides GROUP BY 1, 2),
    totals AS (SELECT collection_id, CAST(sum(b) AS BIGINT) AS previous_count, CAST(sum(a) AS BIGINT) AS next_count,
        count(*) FILTER (b = 0) AS appended_count, count(*) FILTER (b = 1 AND (a = 0 OR old <> new)) AS changed,
        min(sequence) FILTER (b = 0) AS first_sequence, max(sequence) FILTER (b = 0) AS last_sequence,
        arg_min(head, sequence) FILTER (b = 0) AS first_packet_sha256,
        arg_max(head, sequence) FILTER (b = 0) AS last_packet_sha256
      FROM positions GROUP BY 1)
    SELECT * EXCLUDE (changed), CASE WHEN previous_count = 0 OR changed > 0 OR appended_count NOT BETWEEN 1 AND 99
        OR first_sequence <> previous_count + 1 OR last_sequence <> next_count
      THEN 'PACKET_COLLECTION_TRANSITION_MISMATCH' END AS failure_code FROM totals"""
)
def exact_append(spark: SparkSession, folder: str) -> DataFrame:
    """From two packets to all; by ``collection_id % 4``: 1 rewritten, 2 nothing new, 3 gap."""
    rows = packets(spark, folder)
    form = F.pmod("collection_id", F.lit(4))
    following = rows.where(
        ~((form == 2) & (c("sequence") > 2)) & ~((form == 3) & (c("sequence") == 3))
    ).withColumn(
        "source_byte_length",
        F.when((form == 1) & (c("sequence") == 1), c("source_byte_length") + 1).otherwise(c("source_byte_length")),
    )
    digest = canonical_digest({"size": c("source_byte_length"), "head": c("packet_sha256")})
    return chains.exact_append(rows.where(c("sequence") <= 2), following, COLLECTION, digest)


@query(
    f"""WITH RECURSIVE {HEADS_SQL}, counts AS (SELECT collection_id, max(sequence) AS n FROM entries GROUP BY 1),
    faults AS (SELECT b.*, n, collection_id % 7 IN (1, 2, 3) AND n > 1 AS bad
      FROM bundled b JOIN counts USING (collection_id) WHERE sequence = n)
    SELECT collection_id, CAST(n - CASE WHEN collection_id % 7 = 1 AND n > 1 THEN 1 ELSE 0 END
        + CASE WHEN collection_id % 7 = 3 AND n > 1 THEN 1 ELSE 0 END AS BIGINT) AS packet_count,
      CASE WHEN bad THEN 'PACKET_COLLECTION_BUNDLE_INVALID' END AS failure_code,
      CASE WHEN NOT bad THEN index_sha256 END AS index_sha256, CASE WHEN NOT bad THEN audit_sha256 END AS audit_sha256,
      CASE WHEN NOT bad THEN packets_sha256 END AS packets_sha256, CASE WHEN NOT bad THEN bundle_sha256 END AS bundle_sha256,
      CASE WHEN NOT bad THEN string_split(items, '"entrySha256":"')[2][1:64] END AS first_entry
    FROM faults"""
)
def bundle_export(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 7`` an entry is 1 missing (the first), 2 without its place, 3 there twice (the second)."""
    form, second = F.pmod("collection_id", F.lit(7)), c("sequence") == 2
    first = (form == 1) & (c("sequence") == 1)
    sizes = packets(spark, folder).groupBy("collection_id").agg(F.max("sequence").alias("_n"))
    rows = (
        entries(spark, folder)
        .join(sizes, "collection_id")
        .where(~(first & (c("_n") > 1)))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when((form == 3) & second, 2).otherwise(1))))
        .withColumn("sequence", F.when(~((form == 2) & second), c("sequence")))
        .drop("_n", "_copy")
    )
    return export.bundle_export(rows, COLLECTION).select(
        "collection_id", "packet_count", "failure_code", "index_sha256", "audit_sha256", "packets_sha256", "bundle_sha256",
        F.get("entries", F.lit(0))["entrySha256"].alias("first_entry"),
    )
