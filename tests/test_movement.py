"""Wide rows move as seldom as the job allows, and odd rows keep their results."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from quotelock.functions.digests import packed, unpacked
from quotelock.operators import audits
from quotelock.operators.releases import upgrade_binding_check
from quotelock.operators.trust import signature_filter, signer_quorum


@contextmanager
def settings(spark, **values):
    """Without broadcasts and adaptive changes, as with large tables."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", **values}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def exchanged(rows, column):
    """Exchanges of the plan whose rows have the column, without reused ones."""
    plan = rows._jdf.queryExecution().executedPlan()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            output = node.output()
            if column in [output.apply(i).name() for i in range(output.size())]:
                found.append(node.toString())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return len(found)


def types(rows, column):
    """Types of the column in the rows of all exchanges."""
    plan = rows._jdf.queryExecution().executedPlan()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            output = [node.output().apply(i) for i in range(node.output().size())]
            found += [field.dataType().simpleString() for field in output if field.name() == column]
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


SIGNATURES = "report_id int, key_id string, report_sha256 string, signature_valid boolean, signature_order int, n int"


def signed(spark, rows, reports=((1, "r"), (2, "r")), revoked=()):
    signatures = spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], SIGNATURES)
    known = spark.createDataFrame(list(reports), "report_id int, expected_sha256 string")
    trusted = spark.createDataFrame([("k",), ("o",), ("k",), (None,)], "key_id string")
    bad = spark.createDataFrame([(key,) for key in revoked], "key_id string")
    return signature_filter(signatures, known, trusted, bad)


def test_signatures_move_once_by_report(spark):
    with settings(spark):
        found = signed(spark, [(1, "k", "r", True, 1)])
        # Once to the flags of their keys, where these are not broadcast, and once to their report.
        assert exchanged(found, "report_sha256") <= 2
        assert exchanged(found, "signature_order") <= 2


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_odd_signatures(spark, threshold):
    rows = [
        (1, "k", "r", True, 2), (1, "k", "r", True, 1), (1, "o", "r", True, None), (1, "o", "r", True, 1),
        (2, "x", "r", True, 1), (2, "x", "r", True, 1), (2, None, "r", True, 1), (2, "k", "r", False, 1),
        (None, "k", "r", True, 1), (3, "k", "r", True, 1), (None, None, None, None, None),
    ]
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": threshold}):
        found = signed(spark, rows, [(1, "r"), (2, "r"), (2, "r"), (None, "r")], ["o"])
        got = sorted((row["n"], row["failure_code"], row["counted"]) for row in found.collect())
        report, revoked, twice, invalid = (f"SIGNATURE_{x}" for x in ("REPORT_MISMATCH", "KEY_REVOKED", "SIGNER_DUPLICATE", "INVALID"))
        # A report that is there twice gives its signatures twice, and none of them becomes a copy of itself.
        assert got == [
            (0, twice, False), (1, None, True), (2, revoked, False), (3, revoked, False), *[(4, None, False)] * 2,
            *[(5, None, False)] * 2, *[(6, None, False)] * 2, *[(7, invalid, False)] * 2, (8, report, False),
            (9, report, False), (10, report, False),
        ]
        unordered = signed(spark, rows, [(1, "r")])
        assert {row["failure_code"] for row in unordered.where("n in (2, 3)").collect()} == {twice}
        policies = spark.createDataFrame(
            [(1, 1, 2, None, None), (3, 1, 2, None, None)], "report_id int, threshold int, trusted_count int, valid_from string, valid_until string")
        quorum = signer_quorum(found, policies, F.lit("2026-03-01T00:00:00.000Z"), strict=False)
        assert sorted((row["report_id"], row["verified_signers"], row["failure_code"]) for row in quorum.collect()) == [
            (1, 1, None), (3, 0, "SIGNATURE_THRESHOLD_NOT_MET")]


TEXTS = ["", "a", "ab", "AB", "0ab", "g1", "ab" * 32, "é", "\x01\xab", "00", " ab", "ab ", None]


def test_packed_texts_stay_apart_and_come_back(spark):
    rows = spark.createDataFrame([(text,) for text in TEXTS], "text string")
    got = rows.select("text", packed(F.col("text")).alias("packed")).select("*", unpacked(F.col("packed")).alias("back")).collect()
    assert [row["back"] for row in got] == TEXTS
    assert len({bytes(row["packed"]) for row in got if row["packed"] is not None}) == len(TEXTS) - 1
    assert {row["text"]: len(row["packed"]) for row in got if row["text"]}["ab" * 32] == 33


def bound(spark, bindings, releases, evidence):
    claim = "evidence_id string, previous_version string, current_version string, previous_manifest_sha256 string, current_manifest_sha256 string"
    return upgrade_binding_check(
        spark.createDataFrame(bindings, "binding_id int, previous_release string, current_release string, evidence_id string"),
        spark.createDataFrame(releases, "release_id string, version string, manifest_sha256 string"),
        spark.createDataFrame(evidence, claim),
    )


def test_bindings_move_without_their_long_ids(spark):
    with settings(spark):
        found = bound(spark, [(1, "p", "q", "e")], [("p", "1.0.0", "m")], [("e", "1.0.0", "1.0.1", "m", "n")])
        found = found.select("binding_id", "failure_code")
        for name in ("previous_release", "current_release", "evidence_id", "release_id", "manifest_sha256", "previous_manifest_sha256"):
            assert exchanged(found, name) == 0
        assert exchanged(found, "_previous_release") == 2


def test_odd_bindings(spark):
    long = "ab" * 32
    releases = [(long, "1.0.0", "m"), ("q", "1.0.1", long), ("q", "1.0.1", long), (long.upper(), "1.0.0", "x"), (None, "1.0.0", "m")]
    evidence = [("e", "1.0.0", "1.0.1", "m", long), ("f", "1.0.0", "1.0.1", "m", long.upper()), (None, "1.0.0", "1.0.1", "m", long)]
    bindings = [(1, long, "q", "e"), (2, long, "q", "f"), (3, long.upper(), "q", "e"), (4, None, "q", "e"), (5, long, "q", None)]
    got = bound(spark, bindings, releases, evidence).collect()
    wrong = "UPGRADE_BINDING_MANIFEST_MISMATCH"
    assert sorted((row["binding_id"], row["failure_code"]) for row in got if row["binding_id"] != 4) == [
        (1, None), (1, None), (2, wrong), (2, wrong), (3, wrong), (3, wrong),
        (5, "UPGRADE_BINDING_EVIDENCE_MISSING"), (5, "UPGRADE_BINDING_EVIDENCE_MISSING")]
    assert {row["failure_code"] for row in got if row["binding_id"] == 4} == {"UPGRADE_BINDING_VERSION_MISMATCH"}
    assert {(row["previous_release"], row["evidence_id"], row["current_manifest_sha256"]) for row in got if row["binding_id"] == 1} == {(long, "e", long)}


INDEX = "g int, sequence int, pack_sha256 string, kind string, size int"


def audited(spark, index, given):
    return audits.audit(
        spark.createDataFrame(index, INDEX),
        spark.createDataFrame(given, "g int, supply_order int, pack_sha256 string, kind string, size bigint"),
        ["g"], "pack_sha256", {"kind": "kind", "size": "size"}, "P",
    )


def test_audited_texts_move_packed(spark):
    with settings(spark):
        found = audited(spark, [(1, 1, "a", "k", 1)], [(1, 1, "a", "k", 1)])
        assert exchanged(found, "kind") == 0
        assert set(types(found, "pack_sha256")) == {"binary"}


def test_odd_audits(spark):
    long = "ab" * 32
    index = [(1, 1, long, long, 1), (1, 2, "b", None, None), (1, 3, "c", "k", 1), (1, 4, None, "k", 1), (1, 5, "d", long, 1), (1, 6, "e", "k", 1), (1, 6, "e", "k", 1)]
    given = [(1, 1, long, long, 1), (1, 2, "b", None, None), (1, 3, long.upper(), "k", 1), (1, 4, None, "k", 1),
             (1, 5, "d", long.upper(), 1), (1, 6, "c", "k", 1), (1, 6, "c", "k", 1)]
    got = audited(spark, index, given)
    assert got.dtypes == [("g", "int"), ("pack_sha256", "string"), ("position", "bigint"), ("verdict", "string")]
    assert sorted((str(row["pack_sha256"]), row["position"], row["verdict"]) for row in got.collect()) == sorted([
        (long, 1, "VERIFIED"), ("b", 2, "VERIFIED"), (long.upper(), 3, "P_UNEXPECTED"), ("None", 4, "P_UNEXPECTED"), ("None", 4, "P_MISSING"),
        ("d", 5, "P_METADATA_MISMATCH"), ("c", 6, "P_DUPLICATE"), ("c", 6, "P_DUPLICATE"), ("e", 6, "P_MISSING"), ("e", 6, "P_MISSING")])
