"""NULL, repeated and missing records never pass and never vanish."""

import pytest
from pyspark.sql import functions as F

from quotelock.operators import audits, chains, export, lineage, releases, review, trust
from quotelock.plans.blocks import running_sum
from quotelock.streaming.appends import ENTRY_SCHEMA, append_batch

PACKET = (
    "collection_id bigint, append_order bigint, packet_sha256 string, source_sha256 string, "
    "source_byte_length bigint, candidate_id string, evidence_id string"
)


def packet(number, order=None, **changed):
    row = {
        "collection_id": 1, "append_order": number if order is None else order, "packet_sha256": f"{number:064x}",
        "source_sha256": f"{number:064x}", "source_byte_length": 10, "candidate_id": f"c{number}", "evidence_id": f"e{number}",
    }
    return tuple({**row, **changed}.values())


@pytest.fixture(scope="module")
def chain(spark):
    rows = spark.createDataFrame([packet(i) for i in (1, 2, 3)], PACKET).withColumnRenamed("append_order", "sequence")
    return chains.chain_build(rows, ["collection_id"], lineage.packet_payload()).cache()


def test_chain_with_an_entry_without_a_place_is_broken(chain):
    loose = chain.where("sequence = 3").withColumns({"sequence": F.lit(None).cast("bigint"), "entry_sha256": F.lit("0" * 64)})
    row = chains.chain_verify(chain.unionByName(loose), ["collection_id"], lineage.packet_payload()).first()
    assert (row.entries, row.first_broken_sequence) == (4, None) and row.failure_code is not None
    assert chains.chain_verify(chain, ["collection_id"], lineage.packet_payload()).first().failure_code is None


@pytest.mark.parametrize("name", ["sequence", "packet_sha256", "source_sha256", "source_byte_length", "candidate_id",
                                  "evidence_id", "entry_sha256", "previous_entry_sha256"])
def test_no_column_of_an_entry_may_be_missing(chain, name):
    kind = chain.schema[name].dataType
    damaged = chain.withColumn(name, F.when(F.col("packet_sha256") != f"{2:064x}", F.col(name)).cast(kind))
    row = chains.chain_verify(damaged, ["collection_id"], lineage.packet_payload()).first()
    assert row.entries == 3 and row.failure_code is not None


def test_running_sum_keeps_rows_without_order_or_key(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, None, 7), (None, 1, 9), (1, 2, 1)], "k int, n int, v int")
    assert sorted(row.total for row in running_sum(rows, ["k"], "n", F.col("v"), "total").collect()) == [7, 9, 12, 13]


def test_audit_of_places_that_are_missing_or_taken_twice(spark):
    index = chains_index(spark)
    supplied = index.withColumnRenamed("sequence", "position")
    def verdicts(rows):
        return sorted((row.position, row.verdict.removeprefix("PACKET_COLLECTION_")) for row in
                      audits.collection_audit(index, rows, ["collection_id"]).collect() if row.position is not None)
    assert verdicts(supplied) == [(1, "VERIFIED"), (2, "VERIFIED"), (3, "VERIFIED")]
    twice = supplied.unionByName(supplied.where("position = 2"))
    assert verdicts(twice) == [(1, "VERIFIED"), (2, "DUPLICATE"), (2, "DUPLICATE"), (3, "VERIFIED")]
    loose = supplied.withColumn("position", F.when(F.col("position") != 2, F.col("position")))
    rows = audits.collection_audit(index, loose, ["collection_id"])
    assert rows.count() == 3 and rows.where("verdict = 'VERIFIED'").count() == 2
    outcome = audits.audit_outcome(rows, ["collection_id"], prefix="PACKET_COLLECTION").first().outcome
    assert outcome == "PACKET_COLLECTION_ORDER_INVALID"


def chains_index(spark):
    return spark.createDataFrame([packet(i) for i in (1, 2, 3)], PACKET).withColumnRenamed("append_order", "sequence")


@pytest.mark.parametrize("orders", [(1, 3), (1, 1), (2, 3), (1, None), (0, 1)])
def test_appends_with_gaps_or_forks_are_rejected(spark, chain, orders):
    rows = [packet(10 + i, append_order=order) for i, order in enumerate(orders)]
    added = lineage.append_packets(chain, spark.createDataFrame(rows, PACKET), ["collection_id"]).collect()
    assert [row.failure_code for row in added] == ["PACKET_APPEND_GAP"] * 2


def test_append_limits_are_parameters(spark, chain):
    more = spark.createDataFrame([packet(10, append_order=1)], PACKET)
    codes = lambda **limits: [r.failure_code for r in lineage.append_packets(chain, more, ["collection_id"], **limits).collect()]
    assert codes() == [None] and codes(max_entries=3) == ["PACKET_INDEX_FULL"]
    assert codes(max_bytes=39) == ["PACKET_COLLECTION_BYTES_EXCEEDED"]


@pytest.mark.parametrize("name", ["packet_sha256", "candidate_id", "evidence_id"])
def test_streamed_packets_may_not_repeat_any_identity(spark, chain, name):
    stored = chain.withColumn("failure_code", F.lit(None).cast("string")).select(
        *[part.strip().split(" ")[0] for part in ENTRY_SCHEMA.split(",")]
    )
    known = {"packet_sha256": f"{2:064x}", "candidate_id": "c2", "evidence_id": "e2"}[name]
    batch = spark.createDataFrame([packet(4, **{name: known}), packet(5, append_order=None)], PACKET).withColumnRenamed("append_order", "sequence")
    rows = append_batch(batch, stored).collect()
    assert len(rows) == 2 and all(row.failure_code for row in rows)
    assert {row.failure_code for row in rows if row.sequence == 4} == {"PACKET_INDEX_DUPLICATE"}


def test_merge(spark):
    store = spark.createDataFrame([("a", "1"), ("n", None)], "key string, digest string")
    incoming = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("n", "1"), (None, "1"), ("d", None)], store.schema
    )
    got = sorted((str(row.key), str(row.digest), row.merge) for row in review.immutable_merge(store, incoming, "key", "digest").collect())
    assert got == sorted(
        [("a", "1", "identical"), ("a", "2", "conflict"), ("b", "1", "conflict"), ("b", "2", "conflict"),
         ("c", "1", "new"), ("n", "1", "conflict"), ("None", "1", "conflict"), ("d", "None", "conflict")]
    )


def test_quorum_counts_a_bad_signature_without_order(spark):
    policies = spark.createDataFrame([(1, 1, 2, None, None)], "report_id int, threshold int, trusted_count int, valid_from string, valid_until string")
    rows = [(1, "k1", 1, True, None), (1, "k2", None, False, "SIGNATURE_KEY_REVOKED")]
    filtered = spark.createDataFrame(rows, "report_id int, key_id string, signature_order int, counted boolean, failure_code string")
    at = F.lit("2026-01-01T00:00:00.000Z")
    assert trust.signer_quorum(filtered, policies, at).first().failure_code == "SIGNATURE_KEY_REVOKED"
    assert trust.signer_quorum(filtered.where("counted"), policies, at).first().failure_code is None


def test_manifests_and_checkpoints(spark):
    schema = "pair int, name string, digest string"
    old = spark.createDataFrame([(1, "a", "1"), (1, "b", None), (1, "c", "1"), (1, "c", "1")], schema)
    new = spark.createDataFrame([(1, "a", "2"), (1, "b", None), (1, "c", "1"), (1, "d", "1"), (1, None, "1")], schema)
    got = {row.name: row.change for row in releases.manifest_diff(old, new, ["pair", "name"]).collect()}
    assert got == {"a": "changed", "b": "invalid", "c": "invalid", "d": "added", None: "invalid"}
    schema = "suite int, packet_count int, lineage_bytes int, append_ms double, verify_ms double"
    base = spark.createDataFrame([(1, 10, 5, 1.0, 1.0)], schema)
    more = spark.createDataFrame([(1, 10, 5, 1.0, 1.0), (1, 20, 5, 9.0, 9.0)], schema)
    for sides in ((base, more), (more, base)):
        checkpoints = releases.regression_checkpoints(*sides, ["suite"])
        assert releases.regression_verdict(checkpoints, ["suite"]).first().outcome == "invalid"


def test_policies_must_be_numbered_without_gaps(spark):
    probes = spark.createDataFrame([(1, 50, "p"), (2, 50, "q"), (None, 50, "r"), (1, None, "s")], "key int, at int, probe string")
    policies = spark.createDataFrame([(1, 10, 1), (1, 99, 2), (2, 10, 1), (2, 20, 3)], "key int, since int, sequence int")
    rows = trust.active_policy_asof(policies, probes, ["key"], "since", "at", ["sequence"]).collect()
    got = {row.probe: (row.scheduled_count, row.failure_code) for row in rows}
    assert got["p"] == (1, None) and got["q"] == (None, "POLICY_SEQUENCE_INVALID")
    assert got["r"][1] == got["s"][1] == "POLICY_NOT_YET_ACTIVE"


def test_packets_need_their_bytes(spark):
    view = "struct<kind:string,transformation:string,source_sha256:string,media_type:string,sha256:string,byte_length:bigint>"
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    rows = [(ref, "c", "e", "text/plain", sha, size, "p", "u", "t", "t", "TextQuoteSelector", "x", "", "", None, "t", "t")
            for ref, sha, size in (("good", digest, 4), ("gone", digest, 4), ("good", digest, 5), ("good", "0" * 64, 4))]
    evidence = spark.createDataFrame(
        rows,
        "snapshot_ref string, candidate_id string, evidence_id string, media_type string, sha256 string, byte_length bigint, "
        "object_path string, source_uri string, captured_at string, available_at string, selector_type string, exact string, "
        f"prefix string, suffix string, citation_view {view}, observed_at string, verified_at string",
    ).withColumn("n", F.monotonically_increasing_id())
    contents = spark.createDataFrame([("good", "test")], "snapshot_ref string, content string")
    packets = export.packet_export(evidence, contents).orderBy("n").collect()
    assert [row.failure_code for row in packets] == [None, "SNAPSHOT_MISSING", "SNAPSHOT_SIZE_MISMATCH", "SNAPSHOT_HASH_MISMATCH"]
    assert [row.packet_sha256 is None for row in packets] == [False, True, True, True]
