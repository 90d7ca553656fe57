"""Heads against plain canonical JSON, and lineages with every row faulted in turn."""

import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quotelock.operators import export, lineage
from quotelock.operators.chains import chain_build
from quotelock.operators.heads import collection_heads, prefix_heads

PACKET = "c string, sequence bigint, packet_sha256 string, source_sha256 string, source_byte_length bigint, candidate_id string, evidence_id string"
KIND = "Quotelock"
PLAIN = {"timestamp": "not-attested"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(value):
    return sha(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def packet(chain, number):
    key = f"{chain}-{number}"
    return (chain, number, sha(f"p{key}"), sha(f"s{key}"), number + 4, f"cand \"{key}\" é", f"ev{key}")


def plain_entries(chain, count):
    entries, link = [], None
    for number in range(1, count + 1):
        _, _, head, source, size, candidate, evidence = packet(chain, number)
        entry = {
            "sequence": number, "packetSha256": head, "sourceSha256": source, "sourceByteLength": size,
            "candidateId": candidate, "evidenceId": evidence, "previousEntrySha256": link,
        }
        link = digest(entry)
        entries.append({**entry, "entrySha256": link})
    return entries


def plain_bundle(entries):
    index = digest({"version": 1, "kind": f"{KIND}EvidencePacketIndex", "entries": entries, "assurance": PLAIN})
    packets = digest([
        {"name": f"packets/{e['packetSha256']}.json", "packetSha256": e["packetSha256"], "sourceByteLength": e["sourceByteLength"],
         "sourceSha256": e["sourceSha256"]} for e in entries])
    audit = digest({
        "version": 1, "kind": f"{KIND}EvidencePacketCollectionAuditReceipt", "outcome": "verified",
        "index": {"indexSha256": index, "packetCount": len(entries)},
        "coverage": {"firstPacketSha256": entries[0]["packetSha256"], "lastPacketSha256": entries[-1]["packetSha256"],
                     "totalSourceBytes": sum(e["sourceByteLength"] for e in entries)},
        "assurance": PLAIN})
    return digest({
        "version": 1, "kind": f"{KIND}EvidencePacketCollectionBundle", "indexSha256": index, "auditSha256": audit,
        "packetsSha256": packets, "assurance": PLAIN})


@pytest.fixture(scope="module")
def entries(spark):
    rows = [packet(chain, number) for chain, count in (("a", 5), ("b", 1), ("d", 3)) for number in range(1, count + 1)]
    return chain_build(spark.createDataFrame(rows, PACKET), ["c"], lineage.packet_payload()).cache()


@pytest.fixture(scope="module")
def whole(spark, entries):
    moves = lineage.transitions_of(entries, ["c"]).cache()
    kept = moves.drop("first_sequence", "last_sequence", "first_packet_sha256", "last_packet_sha256")
    return entries, chain_build(kept, ["c"], lineage.transition_payload()).cache(), moves.withColumn("position", F.col("sequence"))


def test_heads_of_all_prefixes(entries):
    got = {(row["c"], row["sequence"]): row for row in prefix_heads(entries, ["c"]).collect()}
    for (chain, number), row in got.items():
        assert row["bundle_sha256"] == plain_bundle(plain_entries(chain, number))
        assert row["previous_bundle_sha256"] == (plain_bundle(plain_entries(chain, number - 1)) if number > 1 else None)
    last = {row["c"]: row["bundle_sha256"] for row in collection_heads(entries, ["c"]).collect()}
    assert last == {chain: got[chain, count]["bundle_sha256"] for chain, count in (("a", 5), ("b", 1), ("d", 3))}
    bundles = {row["c"]: row for row in export.bundle_export(entries, ["c"]).collect()}
    assert {chain: row["bundle_sha256"] for chain, row in bundles.items()} == last
    assert [e["sequence"] for e in bundles["a"]["entries"]] == [1, 2, 3, 4, 5]
    assert export.bundle_export(entries, ["c"], max_packets=3).where("c = 'a'").first()["failure_code"] == "PACKET_COLLECTION_COUNT_INVALID"


def faulted(rows, at):
    """``rows`` of one chain with one repeated, dropped, without its place, at another place, or changed."""
    row = rows[at].asDict()
    rest = rows[:at] + rows[at + 1 :]
    yield "repeat", [*rows, rows[at]]
    yield "drop", rest
    yield "null", [*rest, Row(**{**row, "sequence": None})]
    yield "gap", [*rest, Row(**{**row, "sequence": row["sequence"] + 7})]
    yield "change", [*rest, Row(**{**row, "entry_sha256": sha("other")})]


def renamed(rows, chain):
    return [Row(**{**row.asDict(), "c": chain}) for row in rows]


def test_faulty_collections_have_no_head(spark, entries):
    """Payloads do not name their chain, so every fault is a chain of its own."""
    whole = sorted(entries.where("c = 'a'").collect(), key=lambda row: row["sequence"])
    rows = renamed(whole, "whole")
    for at in (0, 2, 4):
        for name, changed in faulted(whole, at):
            rows += renamed(changed, f"{name} {at}")
    got = {row["c"]: row for row in export.bundle_export(spark.createDataFrame(rows, entries.schema), ["c"]).collect()}
    assert len(got) == 16
    assert got.pop("whole")["bundle_sha256"] == plain_bundle(plain_entries("a", 5))
    assert got.pop("drop 4")["bundle_sha256"] == plain_bundle(plain_entries("a", 4))
    for name, row in got.items():
        assert row["failure_code"] == "PACKET_COLLECTION_BUNDLE_INVALID", name
        assert row["bundle_sha256"] is None and row["entries"] is None


def verified(parts, **options):
    rows = lineage.lineage_verify(*parts, ["c"], **options).collect()
    return {row["c"]: row for row in rows}


def test_faulty_lineages(spark, whole):
    base = [sorted(part.where("c = 'a'").collect(), key=lambda row: row["sequence"]) for part in whole]
    parts = [renamed(rows, "whole") for rows in base]
    names = []
    for place, kind in enumerate(("entry", "history", "receipt")):
        for at in (0, 1, 3):
            for name, changed in faulted(base[place], at) if kind != "receipt" else (
                ("repeat", [*base[2], base[2][at]]), ("drop", base[2][:at] + base[2][at + 1 :])
            ):
                names.append(f"{kind} {name} {at}")
                for other in range(3):
                    parts[other] += renamed(changed if other == place else base[other], names[-1])
    frames = [spark.createDataFrame(rows, part.schema) for rows, part in zip(parts, whole, strict=True)]
    supplied = frames[0].where("c not like 'entry%'").withColumn("position", F.col("sequence"))
    lost = frames[0].where("c = 'whole'").withColumn("c", F.lit("lost"))
    for at in range(3):
        frames[at] = frames[at].unionByName(frames[at].where("c = 'whole'").withColumn("c", F.lit("lost")))
    supplied = supplied.unionByName(lost.where("sequence <> 3").withColumn("position", F.col("sequence")))
    got = verified(frames, supplied=supplied)
    assert got["whole"]["failure_code"] is None and got["lost"]["failure_code"] == "PACKET_COLLECTION_MISSING"
    assert len(got) == len(names) + 2
    for name in names:
        assert got[name]["failure_code"], name


def test_expected_heads(spark, whole):
    good = verified(whole)
    heads = [("a", good["a"]["lineage_sha256"]), ("d", sha("stale")), ("z", sha("other"))]
    got = verified(whole, expected=spark.createDataFrame(heads, "c string, expected_sha256 string"))
    assert got["a"]["failure_code"] is None and got["a"]["lineage_sha256"]
    assert got["d"]["failure_code"] == "PACKET_LINEAGE_HEAD_MISMATCH"
    assert got["z"]["failure_code"] is not None
    without = verified(whole, expected=spark.createDataFrame(heads[:1], "c string, expected_sha256 string"))
    assert without["d"]["failure_code"] == "PACKET_LINEAGE_ANCHORS_INVALID"


def test_append_extends_history_and_verifies(spark, whole):
    entries, history, receipts = whole
    added = [(*packet(chain, number)[:1], order, *packet(chain, number)[2:]) for chain, number, order in (("a", 6, 1), ("a", 7, 2), ("d", 4, 1))]
    packets = spark.createDataFrame(added, PACKET.replace("sequence", "append_order"))
    done = lineage.append_lineage(entries, history, packets, ["c"])
    done = {name: spark.createDataFrame(rows.collect(), rows.schema) for name, rows in done.items()}
    moves = {row["c"]: row for row in done["receipts"].collect()}
    assert (moves["a"]["previous_packet_count"], moves["a"]["next_packet_count"], moves["a"]["appended_packet_count"]) == (5, 7, 2)
    assert moves["a"]["next_bundle_sha256"] == plain_bundle(plain_entries("a", 7))
    new = done["history"]
    assert sorted((row["c"], row["sequence"], row["failure_code"]) for row in new.collect()) == [("a", 5, None), ("d", 3, None)]
    grown = entries.unionByName(done["entries"].drop("failure_code"))
    longer = history.unionByName(new.drop("failure_code"))
    placed = done["receipts"].join(new.select("c", F.col("sequence").alias("position")), "c")
    columns = [name for name in receipts.columns if name in placed.columns]
    got = verified((grown, longer, receipts.select(*columns).unionByName(placed.select(*columns))))
    assert got["a"]["failure_code"] is None and got["d"]["failure_code"] is None
    assert got["a"]["transition_count"] == 5


def test_transitions_that_do_not_follow(spark, whole):
    _, history, receipts = whole
    last = receipts.where("c = 'a' and sequence = 4").drop("sequence", "position")
    follow = last.select(
        "*", F.lit(1).cast("bigint").alias("append_order")
    ).withColumns({
        "previous_bundle_sha256": F.col("next_bundle_sha256"), "next_bundle_sha256": F.sha2("next_bundle_sha256", 256),
        "previous_index_sha256": F.col("next_index_sha256"), "next_index_sha256": F.sha2("next_index_sha256", 256),
        "previous_packet_count": F.col("next_packet_count"), "next_packet_count": F.col("next_packet_count") + 1,
    })
    follow = spark.createDataFrame(follow.collect(), follow.schema)
    again = follow.withColumn("append_order", F.lit(2).cast("bigint"))
    cases = {
        "follow": follow, "twice reached": follow.unionByName(again), "repeated": follow.unionByName(follow), "late": again,
        "elsewhere": follow.withColumn("previous_packet_count", F.lit(1).cast("bigint")),
    }
    receipts, known = follow.withColumn("c", F.lit(None).cast("string")), history.where("false")
    for name, rows in cases.items():
        receipts = receipts.unionByName(rows.withColumn("c", F.lit(name)))
        known = known.unionByName(history.where("c = 'a'").withColumn("c", F.lit(name)))
    rows = lineage.append_transitions(known, receipts, ["c"]).collect()
    codes = {(row["c"], row["sequence"] if row["c"] == "follow" else None, row["failure_code"]) for row in rows}
    assert codes == {
        ("follow", 5, None), ("twice reached", None, "HISTORY_DUPLICATE"), ("repeated", None, "HISTORY_GAP"),
        ("late", None, "HISTORY_GAP"), ("elsewhere", None, "HISTORY_CONTINUITY_MISMATCH"), (None, None, "HISTORY_INVALID"),
    }
    assert len(rows) == 8
