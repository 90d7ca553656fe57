"""Rows that are repeated, missing, NULL or out of place: never accepted, never lost, never a crash."""

import pytest
from pyspark.sql import functions as F

from quotelock.operators.audits import coverage_adjacency
from quotelock.operators.chains import history_continuity, strictly_increasing
from quotelock.operators.trust import signature_filter, signer_quorum
from quotelock.sources.snapshots import content_dedupe

RELEASES = [("g", n, f"1.{n}.0", f"pack{n}") for n in (1, 2, 3)]
MOVES = [("g", n, f"1.{n}.0", f"1.{n + 1}.0", f"pack{n}", f"pack{n + 1}") for n in (1, 2)]
HISTORY = [("c", n, f"b{n - 1}", f"b{n}") for n in (1, 2, 3)]
VERSIONS = [("c", n, n * 10) for n in (1, 2, 3, 4)]


def coverage(spark, releases, moves):
    rows = coverage_adjacency(
        spark.createDataFrame(releases, "g string, sequence bigint, version string, pack_sha256 string"),
        spark.createDataFrame(
            moves, "g string, sequence bigint, previous_version string, current_version string, "
            "previous_pack_sha256 string, current_pack_sha256 string"),
        ["g"],
    ).collect()
    return {row["g"]: row for row in rows}


def continuity(spark, entries):
    frame = spark.createDataFrame(entries, "c string, sequence bigint, before string, after string")
    return history_continuity(frame, ["c"], {"before": "after"}).collect()


def increasing(spark, entries):
    frame = spark.createDataFrame(entries, "c string, sequence bigint, version bigint")
    return strictly_increasing(frame, ["c"], F.col("version")).collect()


def faults(rows):
    """Each row repeated, dropped, without its place and without its values, in turn; never the last dropped."""
    for at in range(len(rows)):
        row = rows[at]
        yield f"repeat {at}", [*rows, row]
        yield f"no place {at}", [*rows[:at], (row[0], None, *row[2:]), *rows[at + 1 :]]
        yield f"no value {at}", [*rows[:at], (row[0], row[1], *[None] * (len(row) - 2)), *rows[at + 1 :]]
        if at < len(rows) - 1:
            yield f"drop {at}", rows[:at] + rows[at + 1 :]


def test_whole_ones_pass(spark):
    assert coverage(spark, RELEASES, MOVES)["g"]["failure_code"] is None
    assert [row["failure_code"] for row in continuity(spark, HISTORY)] == [None] * 3
    assert [row["failure_code"] for row in increasing(spark, VERSIONS)] == [None] * 4


@pytest.mark.parametrize(("name", "rows"), list(faults(RELEASES)))
def test_faulty_releases(spark, name, rows):
    assert coverage(spark, rows, MOVES)["g"]["failure_code"] is not None


@pytest.mark.parametrize(("name", "rows"), list(faults(MOVES)))
def test_faulty_transitions(spark, name, rows):
    row = coverage(spark, RELEASES, rows)["g"]
    assert row["failure_code"] is not None and row["release_count"] == 3 and row["transition_count"] == len(rows)


def test_a_repeated_transition_multiplies_nothing(spark):
    row = coverage(spark, RELEASES, [*MOVES, MOVES[1]])["g"]
    assert (row["release_count"], row["transition_count"], row["failure_code"]) == (3, 3, "COVERAGE_COUNT_MISMATCH")
    twice = coverage(spark, [*RELEASES, RELEASES[2]], [*MOVES, MOVES[1]])["g"]
    assert twice["failure_code"] == "COVERAGE_RELEASE_MISMATCH"


@pytest.mark.parametrize(("name", "rows"), list(faults(HISTORY)))
def test_faulty_history(spark, name, rows):
    got = continuity(spark, rows)
    assert len(got) == len(rows) and any(row["failure_code"] for row in got)


def test_a_fork_is_seen_at_its_place(spark):
    got = continuity(spark, [*HISTORY, ("c", 2, "b1", "other")])
    codes = sorted((row["sequence"], str(row["failure_code"])) for row in got)
    assert codes == [(1, "None"), (2, "HISTORY_FORK"), (2, "HISTORY_FORK"), (3, "HISTORY_GAP")]


@pytest.mark.parametrize(("name", "rows"), list(faults(VERSIONS)))
def test_faulty_versions(spark, name, rows):
    got = increasing(spark, rows)
    assert len(got) == len(rows) and any(row["failure_code"] for row in got)


def test_versions_with_a_gap(spark):
    got = increasing(spark, [("c", 1, 5), ("c", 3, 4), ("c", None, 9)])
    assert [row["failure_code"] for row in sorted(got, key=lambda row: row["version"])] == ["SEQUENCE_GAP", None, "SEQUENCE_GAP"]


def test_one_signer_twice_in_one_place(spark):
    rows = [(1, "k", "r", True, 1), (1, "k", "r", True, 1), (1, "other", "r", True, 2), (2, "k", "r", True, 1), (2, "k", "r", True, 3)]
    signatures = spark.createDataFrame(rows, "report_id int, key_id string, report_sha256 string, signature_valid boolean, signature_order int")
    reports = spark.createDataFrame([(1, "r"), (2, "r")], "report_id int, expected_sha256 string")
    trusted = spark.createDataFrame([("k",), ("other",)], "key_id string")
    found = signature_filter(signatures, reports, trusted, trusted.where("false"))
    got = sorted((row["report_id"], row["key_id"], str(row["failure_code"]), row["counted"]) for row in found.collect())
    assert got == [
        (1, "k", "SIGNATURE_SIGNER_DUPLICATE", False), (1, "k", "SIGNATURE_SIGNER_DUPLICATE", False), (1, "other", "None", True),
        (2, "k", "None", True), (2, "k", "SIGNATURE_SIGNER_DUPLICATE", False)]
    policies = spark.createDataFrame(
        [(1, 1, 2, None, None)], "report_id int, threshold int, trusted_count int, valid_from string, valid_until string")
    row = signer_quorum(found.where("report_id = 1"), policies, F.lit("2026-03-01T00:00:00.000Z")).first()
    assert (row["verified_signers"], row["failure_code"]) == (1, "SIGNATURE_SIGNER_DUPLICATE")


def test_stored_without_a_digest_is_not_written_over(spark):
    incoming = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", "5")], "snapshot_ref string, sha256 string")
    stored = spark.createDataFrame([("1", None), ("2", "2"), ("3", "x"), ("5", "5"), ("5", None)], "sha256 string, stored_sha256 string")
    got = {row["sha256"]: row["outcome"] for row in content_dedupe(incoming, stored).collect()}
    bad = "SNAPSHOT_HASH_MISMATCH"
    assert got == {"1": bad, "2": "present", "3": bad, None: bad, "5": bad}
    alone = {row["sha256"]: row["outcome"] for row in content_dedupe(incoming).collect()}
    assert alone[None] == bad and alone["1"] == "store"
