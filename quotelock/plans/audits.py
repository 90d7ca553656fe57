"""Audit queries: supplied rows against indexes, receipts, heads and lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelock.functions.digests import canonical_digest
from quotelock.operators import audits, lineage, receipts
from quotelock.operators.chains import chain_build, collection_totals, history_coverage
from quotelock.operators.heads import collection_heads
from quotelock.plans.chains import COLLECTION, HEADS_SQL, HISTORY_SQL, TRANSITIONS_SQL, history_entry_sql, receipt_sql, transitions
from quotelock.plans.checkpoints import cut_lineage
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    ENTRIES_SQL,
    PACKETS_SQL,
    RELEASES_SQL,
    SUPPLIED_SQL,
    UPGRADES_SQL,
    entries,
    packets,
    releases,
    supplied,
    upgrades,
    version_sql,
)
from quotelock.sources.records import closed_records

c = F.col


@query(
    f"""WITH {PACKETS_SQL}, {SUPPLIED_SQL}, ranked AS (
      SELECT *, min(position) OVER (PARTITION BY collection_id, packet_sha256) AS first_position,
        sum(source_byte_length) OVER (PARTITION BY collection_id ORDER BY position) AS total FROM supplied)
    SELECT r.collection_id, r.packet_sha256, r.position, CASE
        WHEN r.position > first_position THEN 'PACKET_COLLECTION_DUPLICATE'
        WHEN p.sequence IS NULL THEN 'PACKET_COLLECTION_UNEXPECTED'
        WHEN p.sequence <> r.position THEN 'PACKET_COLLECTION_REORDERED'
        WHEN p.candidate_id <> r.candidate_id THEN 'PACKET_COLLECTION_METADATA_MISMATCH'
        ELSE 'VERIFIED' END AS verdict
    FROM ranked r LEFT JOIN packets p ON p.collection_id = r.collection_id AND p.packet_sha256 = r.packet_sha256
    UNION ALL
    SELECT p.collection_id, p.packet_sha256, p.sequence, 'PACKET_COLLECTION_MISSING' FROM packets p
    WHERE NOT EXISTS (SELECT 1 FROM supplied s WHERE s.collection_id = p.collection_id
      AND s.packet_sha256 = p.packet_sha256)"""
)
def collection_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audits.collection_audit(
        packets(spark, folder), supplied(spark, folder), COLLECTION
    )


@query(
    f"""WITH {PACKETS_SQL}, {SUPPLIED_SQL}
    SELECT collection_id, sequence, packet_sha256 FROM packets p WHERE NOT EXISTS (SELECT 1 FROM supplied s
      WHERE s.collection_id = p.collection_id AND s.packet_sha256 = p.packet_sha256)"""
)
def missing_items(spark: SparkSession, folder: str) -> DataFrame:
    absent = audits.missing_items(
        packets(spark, folder), supplied(spark, folder), ["collection_id", "packet_sha256"]
    )
    return absent.select("collection_id", "sequence", "packet_sha256")


def _packs(spark: SparkSession, folder: str) -> DataFrame:
    """Packs by ``release_key % 9``: 1 not supplied, 2 supplied twice, 3 foreign, 4 other version."""
    form = F.pmod("release_key", F.lit(9))
    copies = F.when(form == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        releases(spark, folder)
        .where(form != 1)
        .withColumn("_copy", F.explode(copies))
        .withColumns(
            {
                "pack_sha256": F.when(form == 3, F.sha2("pack_sha256", 256)).otherwise(c("pack_sha256")),
                "release_version": F.when(form == 4, F.concat("release_version", F.lit("x"))).otherwise(
                    c("release_version")
                ),
                "supply_order": c("release_key") * 2 + c("_copy"),
            }
        )
    )


@query(
    f"""WITH {RELEASES_SQL}, given AS (
      SELECT product_id, release_key % 9 AS form, copy, release_key * 2 + copy AS position,
        CASE WHEN release_key % 9 = 3 THEN sha256(pack_sha256) ELSE pack_sha256 END AS pack_sha256
      FROM releases, unnest(range(CASE WHEN release_key % 9 = 2 THEN 2 ELSE 1 END)) AS t(copy)
      WHERE release_key % 9 <> 1)
    SELECT product_id, pack_sha256, position, CASE WHEN copy = 1 THEN 'ARCHIVE_PACK_DUPLICATE'
      WHEN form = 3 THEN 'ARCHIVE_PACK_UNEXPECTED' WHEN form = 4 THEN 'ARCHIVE_PACK_METADATA_MISMATCH'
      ELSE 'VERIFIED' END AS verdict FROM given
    UNION ALL
    SELECT product_id, pack_sha256, sequence, 'ARCHIVE_PACK_MISSING' FROM releases WHERE release_key % 9 IN (1, 3)"""
)
def archive_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audits.archive_audit(releases(spark, folder), _packs(spark, folder), ["product_id"])


@query(
    f"""WITH {UPGRADES_SQL}
    SELECT product_id, binding_sha256, release_key AS position, CASE WHEN release_key % 8 = 3
      THEN 'UPGRADE_AUDIT_BINDING_METADATA_MISMATCH' ELSE 'VERIFIED' END AS verdict
    FROM upgrades WHERE release_key % 8 <> 1
    UNION ALL SELECT product_id, binding_sha256, sequence, 'UPGRADE_AUDIT_BINDING_MISSING' FROM upgrades
    WHERE release_key % 8 = 1"""
)
def upgrade_audit(spark: SparkSession, folder: str) -> DataFrame:
    """By ``release_key % 8``: 1 not supplied, 3 with another previous pack."""
    index = upgrades(spark, folder)
    form = F.pmod("release_key", F.lit(8))
    given = index.where(form != 1).withColumns(
        {
            "previous_pack_sha256": F.when(form == 3, F.sha2("previous_pack_sha256", 256)).otherwise(
                c("previous_pack_sha256")
            ),
            "supply_order": c("release_key"),
        }
    )
    return audits.upgrade_audit(index, given, ["product_id"])


def _given_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 4``: 1 the first is missing, 2 swapped, 3 another count, at 1 and 2."""
    form, at = F.pmod("collection_id", F.lit(4)), c("sequence")
    return (
        transitions(spark, folder)
        .where(~((form == 1) & (at == 1)))
        .withColumns(
            {
                "position": F.when((form == 2) & (at <= 2), 3 - at).when(form == 1, at - 1).otherwise(at),
                "next_packet_count": F.when(
                    (form == 3) & (at == 2), c("next_packet_count") + 1
                ).otherwise(c("next_packet_count")),
            }
        )
    )


@query(
    f"""WITH RECURSIVE {TRANSITIONS_SQL}
    SELECT collection_id, transition_audit_sha256, CASE WHEN form = 2 AND sequence <= 2 THEN 3 - sequence
        WHEN form = 1 AND sequence > 1 THEN sequence - 1 ELSE sequence END AS position,
      CASE WHEN form = 1 AND sequence = 1 THEN 'PACKET_TRANSITION_HISTORY_AUDIT_MISSING'
        WHEN form = 1 OR (form = 2 AND sequence <= 2) THEN 'PACKET_TRANSITION_HISTORY_AUDIT_REORDERED'
        WHEN form = 3 AND sequence = 2 THEN 'PACKET_TRANSITION_HISTORY_AUDIT_PROJECTION_MISMATCH'
        ELSE 'VERIFIED' END AS verdict
    FROM (SELECT *, collection_id % 4 AS form FROM receipts)"""
)
def history_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audits.history_audit(transitions(spark, folder), _given_receipts(spark, folder), COLLECTION)


@query(
    """WITH totals AS (SELECT conv_id AS collection_id, count(*) AS packet_count FROM conversations GROUP BY 1)
    SELECT collection_id, packet_count + CASE WHEN collection_id % 5 = 1 THEN 1 ELSE 0 END AS packet_count,
      CASE WHEN collection_id % 5 IN (1, 2) THEN 'PACKET_COLLECTION_AUDIT_MISMATCH' END AS failure_code FROM totals"""
)
def receipt_crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 5`` a receipt has 1 another count or 2 another last head."""
    totals = collection_totals(packets(spark, folder), COLLECTION)
    form = F.pmod("collection_id", F.lit(5))
    retained = totals.withColumns(
        {
            "packet_count": F.when(form == 1, c("packet_count") + 1).otherwise(c("packet_count")),
            "last_packet_sha256": F.when(form == 2, F.sha2("last_packet_sha256", 256)).otherwise(
                c("last_packet_sha256")
            ),
        }
    )
    names = ["packet_count", "total_source_bytes", "first_packet_sha256", "last_packet_sha256"]
    return audits.receipt_crosscheck(retained, totals, COLLECTION, names).select(
        "collection_id", "packet_count", "failure_code"
    )


@query(
    f"""WITH {UPGRADES_SQL}, broken AS (
      SELECT r.product_id, count(*) AS release_count, arg_min(release_version, sequence) AS first_release,
        arg_max(release_version, sequence) AS latest_release FROM releases r GROUP BY 1), kept AS (
      SELECT product_id, count(*) FILTER (NOT (product_id % 5 = 1 AND sequence = 1))
          + count(*) FILTER (product_id % 5 = 3 AND sequence = 2) AS transition_count, count(*) FILTER (product_id % 5 = 4 AND sequence = 3) AS moved,
        count(*) FILTER (product_id % 5 = 2 AND sequence = 2) AS rewritten FROM upgrades GROUP BY 1)
    SELECT b.product_id, release_count, coalesce(transition_count, 0) AS transition_count, first_release, latest_release,
      CASE WHEN release_count <> coalesce(transition_count, 0) + 1 THEN 'COVERAGE_COUNT_MISMATCH'
        WHEN coalesce(rewritten, 0) > 0 OR coalesce(moved, 0) > 0 THEN 'COVERAGE_RELEASE_MISMATCH' END AS failure_code
    FROM broken b LEFT JOIN kept k ON k.product_id = b.product_id"""
)
def coverage_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """By ``product_id % 5``: 1 the first transition is missing, 2 the second is rewritten, 3 it
    comes twice, 4 the third has the place of the second.
    """
    form, at = F.pmod("product_id", F.lit(5)), c("sequence")
    moves = (
        upgrades(spark, folder)
        .where(~((form == 1) & (at == 1)))
        .select(
            "product_id",
            "sequence",
            c("previous_package_version").alias("previous_version"),
            c("current_package_version").alias("current_version"),
            F.when((form == 2) & (at == 2), F.sha2("previous_pack_sha256", 256))
            .otherwise(c("previous_pack_sha256"))
            .alias("previous_pack_sha256"),
            "current_pack_sha256",
        )
    )
    moves = moves.withColumn("_copies", F.when((form == 3) & (at == 2), 2).otherwise(1)).select(
        "*", F.explode(F.sequence(F.lit(1), "_copies"))
    )
    moves = moves.withColumn("sequence", F.when((form == 4) & (at == 3), at - 1).otherwise(at))
    rows = releases(spark, folder).select(
        "product_id", "sequence", c("release_version").alias("version"), "pack_sha256"
    )
    return audits.coverage_adjacency(rows, moves, ["product_id"])


@query(
    f"""WITH RECURSIVE {HEADS_SQL}, heads AS (
      SELECT collection_id, sequence AS packet_count, bundle_sha256 AS head_sha256
      FROM bundled QUALIFY sequence = max(sequence) OVER (PARTITION BY collection_id))
    SELECT collection_id, head_sha256, packet_count + CASE WHEN collection_id % 5 = 2 THEN 1 ELSE 0 END AS packet_count,
      CASE WHEN packet_count = 1 OR collection_id % 5 = 1 THEN 'PACKET_LINEAGE_ENDPOINT_HEAD_MISMATCH'
        WHEN collection_id % 5 = 2 THEN 'PACKET_LINEAGE_ENDPOINT_COUNT_MISMATCH' END AS failure_code FROM heads"""
)
def endpoint_match(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 5``: 1 the last transition ends elsewhere, 2 another count."""
    form = F.pmod("collection_id", F.lit(5))
    heads = collection_heads(entries(spark, folder), COLLECTION).select(
        "collection_id",
        c("bundle_sha256").alias("head_sha256"),
        F.when(form == 2, c("packet_count") + 1).otherwise(c("packet_count")).alias("packet_count"),
    )
    last = audits.latest_entry(
        transitions(spark, folder).select("collection_id", "sequence", "next_bundle_sha256", "next_packet_count"),
        COLLECTION,
    ).withColumn(
        "next_bundle_sha256",
        F.when(form == 1, F.sha2("next_bundle_sha256", 256)).otherwise(c("next_bundle_sha256")),
    )
    return audits.endpoint_match(
        heads, last, COLLECTION, ("head_sha256", "next_bundle_sha256"), [("packet_count", "next_packet_count")]
    ).select("collection_id", "head_sha256", "packet_count", "failure_code")


@query(
    f"""WITH RECURSIVE {ENTRIES_SQL}, heads AS (
      SELECT collection_id, arg_max(entry_sha256, sequence) AS head_sha256 FROM entries GROUP BY 1)
    SELECT collection_id, head_sha256, CASE collection_id % 6 WHEN 2 THEN 'short' WHEN 3 THEN sha256(head_sha256)
        WHEN 1 THEN NULL ELSE head_sha256 END AS expected_sha256,
      CASE collection_id % 6 WHEN 1 THEN 'ANCHORS_INVALID' WHEN 2 THEN 'HEAD_INVALID' WHEN 3 THEN 'HEAD_MISMATCH' END
        AS failure_code FROM heads
    UNION ALL SELECT -1 - collection_id, NULL, head_sha256, 'ANCHORS_INVALID' FROM heads WHERE collection_id % 6 = 4"""
)
def expected_head_check(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 6``: 1 no anchor, 2 no digest, 3 stale, 4 one surplus anchor."""
    heads = entries(spark, folder).groupBy("collection_id").agg(
        F.max_by("entry_sha256", "sequence").alias("head_sha256")
    )
    form = F.pmod("collection_id", F.lit(6))
    kept = heads.where(form != 1).select(
        "collection_id",
        F.when(form == 2, F.lit("short"))
        .when(form == 3, F.sha2("head_sha256", 256))
        .otherwise(c("head_sha256"))
        .alias("expected_sha256"),
    )
    surplus = heads.where(form == 4).select(
        (-1 - c("collection_id")).alias("collection_id"), c("head_sha256").alias("expected_sha256")
    )
    return audits.expected_head_check(heads, kept.unionByName(surplus), COLLECTION)


@query(
    f"""WITH RECURSIVE {HISTORY_SQL}, counts AS (SELECT collection_id, max(sequence) AS n FROM entries GROUP BY 1),
    grown AS (
      SELECT b.collection_id, 2 AS sequence, o.bundle_sha256 AS previous_bundle_sha256, b.bundle_sha256 AS next_bundle_sha256,
        o.index_sha256 AS previous_index_sha256, b.index_sha256 AS next_index_sha256, 2 AS previous_packet_count,
        n AS next_packet_count, f.packet_sha256 AS first_packet, b.packet_sha256 AS last_packet
      FROM bundled b JOIN counts k ON k.collection_id = b.collection_id AND b.sequence = n AND n > 2
        JOIN bundled o ON o.collection_id = b.collection_id AND o.sequence = 2
        JOIN entries f ON f.collection_id = b.collection_id AND f.sequence = 3
      WHERE b.collection_id % 4 <> 1),
    receipted AS (SELECT *, {receipt_sql('first_packet', 'last_packet')} AS transition_audit_sha256 FROM grown)
    SELECT 'entry' AS kind, e.collection_id, e.sequence,
      CASE WHEN e.collection_id % 4 <> 1 THEN e.previous_entry_sha256 END AS previous_entry_sha256,
      CASE WHEN e.collection_id % 4 <> 1 THEN e.entry_sha256 END AS entry_sha256,
      CASE WHEN e.collection_id % 4 = 1 THEN 'PACKET_INDEX_DUPLICATE' END AS failure_code
    FROM entries e JOIN counts k ON k.collection_id = e.collection_id WHERE e.sequence > 2
    UNION ALL
    SELECT 'history', r.collection_id, r.sequence, CASE WHEN r.collection_id % 8 <> 2 THEN h.entry END,
      CASE WHEN r.collection_id % 8 <> 2 THEN {history_entry_sql('h.entry')} END,
      CASE WHEN r.collection_id % 8 = 2 THEN 'HISTORY_CONTINUITY_MISMATCH' END
    FROM receipted r JOIN history h ON h.collection_id = r.collection_id AND h.sequence = 1"""
)
def lineage_append(spark: SparkSession, folder: str) -> DataFrame:
    """From two packets to all, and the transition onto the history.

    In every fourth collection a packet is repeated, and of every eighth (2) the history
    ends elsewhere.
    """
    rows = packets(spark, folder)
    current = cut_lineage(chain_build(rows.where(c("sequence") <= 2), COLLECTION, lineage.packet_payload()))
    repeat = (F.pmod("collection_id", F.lit(4)) == 1) & (c("sequence") == 3)
    added = (
        rows.where(c("sequence") > 2)
        .withColumn("append_order", c("sequence") - 2)
        .withColumn(
            "evidence_id",
            F.when(repeat, F.concat(F.lit("ev-"), "collection_id", F.lit("-0"))).otherwise(c("evidence_id")),
        )
        .drop("sequence")
    )
    history = cut_lineage(_history(lineage.transitions_of(current, COLLECTION)))
    elsewhere = history.withColumn(
        "next_bundle_sha256",
        F.when(F.pmod("collection_id", F.lit(8)) == 2, F.sha2("next_bundle_sha256", 256)).otherwise(c("next_bundle_sha256")),
    )
    done = lineage.append_lineage(current, elsewhere, added, COLLECTION)
    columns = ["collection_id", "sequence", "previous_entry_sha256", "entry_sha256", "failure_code"]
    return (
        done["entries"].select(F.lit("entry").alias("kind"), *columns)
        .unionByName(done["history"].select(F.lit("history").alias("kind"), *columns))
    )


def _history(moves: DataFrame) -> DataFrame:
    """The history chain of one-step receipts."""
    kept = moves.drop("first_sequence", "last_sequence", "first_packet_sha256", "last_packet_sha256")
    return chain_build(kept, COLLECTION, lineage.transition_payload())


@query(
    f"""WITH RECURSIVE {HISTORY_SQL}, ends AS (
      SELECT collection_id, count(*) AS transition_count, string_agg('{{"appendedPacketCount":1,"entrySha256":"' || entry ||
        '","nextBundleSha256":"' || next_bundle_sha256 || '","nextIndexSha256":"' || next_index_sha256 || '","nextPacketCount":' ||
        next_packet_count || ',"previousBundleSha256":"' || previous_bundle_sha256 || '","previousEntrySha256":' ||
        coalesce('"' || link || '"', 'null') || ',"previousIndexSha256":"' || previous_index_sha256 || '","previousPacketCount":' ||
        previous_packet_count || ',"sequence":' || sequence || ',"transitionAuditSha256":"' || transition_audit_sha256 || '"}}', ','
        ORDER BY sequence) AS moves_text FROM history GROUP BY 1),
    heads AS (
      SELECT b.collection_id, b.sequence AS n, b.bundle_sha256, e.transition_count,
        sha256('{{"assurance":{{"timestamp":"not-attested"}},"entries":[' || moves_text ||
          '],"kind":"QuotelockEvidencePacketTransitionHistoryIndex","version":1}}') AS history_sha256
      FROM bundled b LEFT JOIN ends e ON e.collection_id = b.collection_id
      QUALIFY b.sequence = max(b.sequence) OVER (PARTITION BY b.collection_id)),
    checked AS (
      SELECT *, sha256('{{"assurance":{{"timestamp":"not-attested"}},"history":{{"indexSha256":"' || history_sha256 ||
        '","transitionCount":' || transition_count ||
        '}},"kind":"QuotelockEvidencePacketTransitionHistoryAuditReceipt","outcome":"verified","version":1}}') AS audit,
        CASE WHEN n = 1 THEN 'PACKET_LINEAGE_INVALID'
          WHEN collection_id % 7 = 2 THEN 'HASH_MISMATCH'
          WHEN collection_id % 7 = 3 THEN 'PACKET_TRANSITION_HISTORY_AUDIT_MISSING'
          WHEN collection_id % 7 = 4 THEN 'PACKET_COLLECTION_MISSING'
          WHEN collection_id % 7 = 1 AND n > 2 THEN 'PACKET_LINEAGE_ENDPOINT_HEAD_MISMATCH' END AS failure_code FROM heads)
    SELECT collection_id, n - CASE WHEN collection_id % 7 = 1 AND n > 2 THEN 1 ELSE 0 END AS packet_count,
      coalesce(transition_count, 0) AS transition_count, failure_code,
      CASE WHEN failure_code IS NULL THEN sha256('{{"assurance":{{"timestamp":"not-attested"}},"bundleSha256":"' || bundle_sha256 ||
        '","historyAuditSha256":"' || audit || '","historySha256":"' || history_sha256 ||
        '","kind":"QuotelockEvidencePacketCollectionLineageBundle","version":1}}') END AS lineage_sha256 FROM checked"""
)
def lineage_verify(spark: SparkSession, folder: str) -> DataFrame:
    """By ``collection_id % 7``: 1 the packet tail is cut off, 2 a history entry is changed, 3 a
    receipt is gone, 4 the last packet was not supplied."""
    form, at = F.pmod("collection_id", F.lit(7)), c("sequence")
    whole = packets(spark, folder)
    chain = cut_lineage(chain_build(whole, COLLECTION, lineage.packet_payload()))
    moves = cut_lineage(lineage.transitions_of(chain, COLLECTION))
    counts = whole.groupBy("collection_id").agg(F.max("sequence").alias("_n"))
    history = _history(moves)
    changed = history.withColumn(
        "entry_sha256",
        F.when((form == 2) & (at == 1) & c("entry_sha256").isNotNull(), F.sha2("entry_sha256", 256)).otherwise(
            c("entry_sha256")
        ),
    )
    cut = chain.join(counts, "collection_id").where(~((form == 1) & (c("_n") > 2) & (at == c("_n"))))
    given = cut.where(~((form == 4) & (c("_n") > 1) & (at == c("_n")))).withColumn("position", at)
    retained = moves.where(~((form == 3) & (at == 1))).withColumn("position", at)
    return lineage.lineage_verify(cut.drop("_n"), changed, retained, COLLECTION, supplied=given.drop("_n")).select(
        "collection_id",
        c("packet_count").cast("bigint").alias("packet_count"),
        c("transition_count").cast("bigint").alias("transition_count"),
        "failure_code",
        "lineage_sha256",
    )


@query(
    f"""WITH RECURSIVE {TRANSITIONS_SQL}, coverage AS (
      SELECT collection_id, count(*) AS n FROM receipts GROUP BY 1)
    SELECT 'transition' AS kind, collection_id, sequence, CASE
      WHEN collection_id % 7 = 1 THEN 'PACKET_COLLECTION_TRANSITION_SCHEMA_INVALID'
      WHEN collection_id % 7 = 2 THEN 'PACKET_COLLECTION_TRANSITION_INTEGRITY_INVALID' END AS failure_code FROM receipts
    UNION ALL
    SELECT 'history', collection_id, n, CASE
      WHEN collection_id % 7 = 3 THEN 'PACKET_TRANSITION_HISTORY_AUDIT_SCHEMA_INVALID'
      WHEN collection_id % 7 = 4 THEN 'PACKET_TRANSITION_HISTORY_AUDIT_INTEGRITY_INVALID' END FROM coverage"""
)
def receipt_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Transition and history receipts; by ``collection_id % 7`` their counts or digests are wrong."""
    form = F.pmod("collection_id", F.lit(7))
    moves = transitions(spark, folder).withColumns(
        {
            "receipt_sha256": F.when(form == 2, F.sha2("transition_audit_sha256", 256)).otherwise(
                c("transition_audit_sha256")
            ),
            "last_sequence": F.when(form == 1, c("last_sequence") + 1).otherwise(c("last_sequence")),
        }
    )
    first = receipts.receipt_validate(moves, receipts.transition_rules())
    covered = history_coverage(transitions(spark, folder), COLLECTION).withColumn(
        "index_sha256", F.sha2("latest_bundle_sha256", 256)
    )
    sealed = covered.withColumn("receipt_sha256", receipts.history_audit_digest()).withColumns(
        {
            "latest_packet_count": F.when(form == 3, c("initial_packet_count")).otherwise(c("latest_packet_count")),
            "receipt_sha256": F.when(form == 4, F.sha2("receipt_sha256", 256)).otherwise(c("receipt_sha256")),
        }
    )
    second = receipts.receipt_validate(sealed, receipts.history_audit_rules())
    return first.select(F.lit("transition").alias("kind"), "collection_id", "sequence", "failure_code").unionByName(
        second.select(
            F.lit("history").alias("kind"),
            "collection_id",
            c("transition_count").alias("sequence"),
            "failure_code",
        )
    )


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """An acceptance report per order; by ``o_orderkey % 8`` one rule is broken."""
    form = F.pmod("o_orderkey", F.lit(8))
    key = c("o_orderkey").cast("string")

    def commit(name: str) -> Column:
        return F.substring(F.sha2(F.concat(F.lit(f"{name}:"), key), 256), 1, 40)

    clean = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(form == 1, 2).otherwise(1).alias("version"),
        F.lit("verified").alias("outcome"),
        F.lit(4).alias("event_count"),
        F.when(form == 2, F.lit("0")).otherwise(F.sha2(F.concat(F.lit("head:"), key), 256)).alias("trusted_head_sha256"),
        F.when(form == 3, F.lit("2026-02-30T00:00:00Z"))
        .when(form == 7, F.lit(None).cast("string"))
        .otherwise(F.lit("2026-03-01T00:00:00Z"))
        .alias("recorded_at"),
        F.lit("EvidenceCandidate").alias("candidate_kind"),
        F.lit("VerifiedEvidence").alias("evidence_kind"),
        F.lit(True).alias("candidate_linked"),
        F.when(form == 4, F.lit("zz")).otherwise(commit("gate")).alias("gate_commit"),
        commit("recorder").alias("recorder_commit"),
        commit("ledger").alias("ledger_commit"),
        F.lit(True).alias("gate_clean"),
        F.lit(True).alias("recorder_clean"),
        F.lit(True).alias("ledger_clean"),
    )
    own = canonical_digest(receipts.report_members())
    return clean.withColumn(
        "report_sha256",
        F.when(form == 5, F.sha2(own, 256)).when(form == 6, F.lit(None).cast("string")).otherwise(own),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'REPORT_SCHEMA_INVALID' WHEN 2 THEN 'REPORT_SCHEMA_INVALID'
         WHEN 3 THEN 'REPORT_TIME_INVALID' WHEN 4 THEN 'REPORT_REVISION_INVALID' WHEN 5 THEN 'REPORT_INTEGRITY_INVALID'
         END AS failure_code,
         CASE WHEN o_orderkey % 8 IN (0, 7) THEN sha256('{"candidateKind":"EvidenceCandidate","candidateLinked":true,"eventCount":4,"evidenceKind":"VerifiedEvidence","outcome":"verified",'
           || CASE WHEN o_orderkey % 8 = 7 THEN '' ELSE '"recordedAt":"2026-03-01T00:00:00Z",' END ||
           '"revisions":{"gate":{"clean":true,"commit":"' || substr(sha256('gate:' || o_orderkey), 1, 40) ||
           '"},"ledger":{"clean":true,"commit":"' || substr(sha256('ledger:' || o_orderkey), 1, 40) ||
           '"},"recorder":{"clean":true,"commit":"' || substr(sha256('recorder:' || o_orderkey), 1, 40) ||
           '"}},"trustedHeadSha256":"' || sha256('head:' || o_orderkey) || '","version":1}') END AS verified_sha256
       FROM orders"""
)
def report_validate(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("o_orderkey", F.lit(8))
    return receipts.report_validate(_reports(spark, folder)).select(
        "o_orderkey", "failure_code", F.when(form.isin(0, 7), c("report_sha256")).alias("verified_sha256")
    )


RECORD_FAULTS = (
    (None, None),
    ("RECORD_UNKNOWN_KEY", "$.extra"),
    ("RECORD_MISSING_KEY", "$.version"),
    ("RECORD_TYPE_INVALID", "$.sequence"),
    ("RECORD_NOT_JSON", "$"),
    ("RECORD_UNKNOWN_KEY", "$.source.extra"),
    ("RECORD_MISSING_KEY", "$.source.byteLength"),
    ("RECORD_VALUE_INVALID", "$.source.sha256"),
    ("RECORD_REPEATED_KEY", "$"),
    ("RECORD_UNKNOWN_KEY", "$.selectors[1].extra"),
    ("RECORD_MISSING_KEY", "$.selectors[0].start"),
    ("RECORD_TYPE_INVALID", "$.selectors[1].start"),
    ("RECORD_VALUE_INVALID", "$.selectors[1].start"),
    ("RECORD_VALUE_INVALID", "$.selectors"),
    ("RECORD_TYPE_INVALID", "$.source"),
    ("RECORD_NOT_JSON", "$"),
    ("RECORD_REPEATED_KEY", "$"),
    (None, None),
    ("RECORD_UNKNOWN_KEY", "$.source.extra"),
)


def _record_cases(which: int) -> str:
    cases = [f"WHEN {form} THEN '{fault[which]}'" for form, fault in enumerate(RECORD_FAULTS) if fault[which]]
    return f"CASE o_orderkey % {len(RECORD_FAULTS)} {' '.join(cases)} END"


RECORD_SCHEMA = T.StructType(
    [
        T.StructField("sequence", T.LongType(), False, {"low": 0}),
        T.StructField("version", T.StringType(), False),
        T.StructField(
            "source",
            T.StructType(
                [
                    T.StructField("sha256", T.StringType(), False, {"pattern": "[0-9a-f]{64}"}),
                    T.StructField("byteLength", T.LongType(), False, {"low": 1}),
                    T.StructField("note", T.StringType(), True, {"optional": True}),
                ]
            ),
            False,
        ),
        T.StructField(
            "selectors",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False, {"low": 0})]), False),
            False,
            {"low": 1, "high": 2},
        ),
    ]
)


@query(
    f"""SELECT o_orderkey, {_record_cases(0)} AS failure_code, {_record_cases(1)} AS failure_path,
         CASE WHEN o_orderkey % {len(RECORD_FAULTS)} IN (0, 17) THEN {version_sql('o_orderkey')} END AS version,
         CASE WHEN o_orderkey % {len(RECORD_FAULTS)} IN (0, 17) THEN sha256('source:' || o_orderkey) END AS source_sha256,
         CASE WHEN o_orderkey % {len(RECORD_FAULTS)} IN (0, 17) THEN o_custkey END AS last_start
       FROM orders"""
)
def closed_record_read(spark: SparkSession, folder: str) -> DataFrame:
    """Release records as JSON lines, broken by ``o_orderkey`` in one place or (18) in two."""
    from quotelock.plans.views import version_of

    form = F.pmod("o_orderkey", F.lit(len(RECORD_FAULTS)))
    text = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    when = lambda number, broken, whole: F.when(form == number, F.lit(broken)).otherwise(whole)
    added = lambda number, broken: when(number, broken, F.lit(""))
    digest = F.sha2(F.concat(F.lit("source:"), c("o_orderkey").cast("string")), 256)
    source = F.concat(
        F.lit('{"sha256":'), F.when(form.isin(7, 18), text(F.upper(digest))).otherwise(text(digest)),
        when(6, "", F.lit(',"byteLength":12')), F.when(form.isin(5, 18), F.lit(',"extra":{}')).otherwise(F.lit("")),
        added(16, ',"sha256":"0"'), added(17, ',"note":null'), F.lit("}"),
    )
    second = F.concat(
        F.lit('{"start":'), F.when(form == 11, F.lit('"4"')).when(form == 12, F.lit("-1")).otherwise(c("o_custkey").cast("string")),
        added(9, ',"extra":1'), F.lit("}"),
    )
    line = F.concat(
        F.lit('{"sequence":'), when(3, '"one"', c("o_orderkey").cast("string")),
        when(2, "", F.concat(F.lit(',"version":'), text(version_of(c("o_orderkey"))))), added(1, ',"extra":true'),
        added(8, ',"sequence":1'), F.lit(',"source":'), when(14, "[]", source),
        F.lit(',"selectors":['), when(10, "{}", F.lit('{"start":0}')), F.lit(","), second, added(13, ',{"start":1}'),
        F.lit("]"), when(4, "", F.lit("}")), added(15, " {}"),
    )
    lines = table(spark, folder, "orders").select("o_orderkey", line.alias("line"))
    return closed_records(lines, "line", RECORD_SCHEMA).select(
        "o_orderkey", "failure_code", "failure_path", "record.version",
        c("record.source.sha256").alias("source_sha256"), F.try_element_at("record.selectors", F.lit(-1))["start"].alias("last_start"),
    )
