"""One valid candidate, one changed field at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quotelock.operators import gate
from quotelock.operators.html_view import html_text_views, render_html

TEXT = "Before. Nine barges crossed at dawn! After."
QUOTE = "Nine barges crossed at dawn!"
SHA = hashlib.sha256(TEXT.encode()).hexdigest()
SCHEMA = (
    "candidate_id string, kind string, snapshot_ref string, media_type string, sha256 string, byte_length bigint, "
    "object_path string, source_uri string, captured_at string, available_at string, selector_type string, "
    f"exact string, prefix string, suffix string, citation_view {gate.VIEW_TYPE}, observed_at string, verified_at string"
)
VALID = {
    "candidate_id": "c1", "kind": "EvidenceCandidate", "snapshot_ref": "s1", "media_type": "text/plain; charset=utf-8",
    "sha256": SHA, "byte_length": len(TEXT.encode()), "object_path": "objects/x", "source_uri": "file:///x",
    "captured_at": "2026-01-02T00:00:00.123456789Z", "available_at": "2026-01-01T00:00:00Z",
    "selector_type": "TextQuoteSelector", "exact": QUOTE, "prefix": "Before. ", "suffix": " After.",
    "citation_view": None, "observed_at": "2026-01-02T00:00:00.123456789Z", "verified_at": "2026-01-03T00:00:00.000Z",
}
ENVELOPE, STAMP = "INVALID_EVIDENCE_ENVELOPE", "INVALID_TIMESTAMP"
# In ladder order; each entry breaks one rule.
FAULTS = [
    ({"kind": "VerifiedEvidence"}, "INVALID_CANDIDATE_KIND"),
    ({"exact": ""}, "SELECTOR_NOT_FOUND"),
    ({"candidate_id": "x" * 257}, ENVELOPE),
    ({"media_type": ""}, ENVELOPE),
    ({"sha256": SHA.upper()}, ENVELOPE),
    ({"byte_length": -1}, ENVELOPE),
    ({"object_path": None}, ENVELOPE),
    ({"source_uri": "x" * 4097}, ENVELOPE),
    ({"captured_at": "2026-02-31T00:00:00Z"}, STAMP),
    ({"available_at": "2026-01-01"}, STAMP),
    ({"selector_type": "Other"}, ENVELOPE),
    ({"prefix": "x" * 33}, ENVELOPE),
    ({"suffix": None}, ENVELOPE),
    ({"observed_at": "2026-01-01T00:00:60Z"}, STAMP),
    ({"available_at": "2026-01-02T00:00:00.123456790Z"}, "TIMESTAMP_ORDER_INVALID"),
    ({"citation_view": ("DerivedCitationView", "html-text@1", SHA, "text/plain; charset=utf-8", SHA, 3)},
     "CITATION_VIEW_INVALID"),
    ({"verified_at": "2026-01-02T00:00:00.123456788Z"}, "VERIFICATION_TIME_INVALID"),
    ({"snapshot_ref": "none"}, "SNAPSHOT_MISSING"),
    ({"byte_length": len(TEXT) + 1}, "SNAPSHOT_SIZE_MISMATCH"),
    ({"sha256": "0" * 64}, "SNAPSHOT_HASH_MISMATCH"),
    ({"exact": "absent"}, "SELECTOR_NOT_FOUND"),
    ({"exact": "r"}, "SELECTOR_AMBIGUOUS"),
    ({"prefix": "efore. "}, "SELECTOR_CONTEXT_MISMATCH"),
    ({"suffix": ""}, "SELECTOR_CONTEXT_MISMATCH"),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([("s1", TEXT)], "snapshot_ref string, content string")


def codes(spark, stored, records, **options):
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]
    frame = spark.createDataFrame(
        [tuple({**record, "candidate_id": record["candidate_id"]}[n] for n in names) for record in records], SCHEMA
    ).withColumn("n", F.monotonically_increasing_id())
    rows = gate.promotion_gate(frame, stored, **options).orderBy("n").collect()
    return [row.failure_code for row in rows]


def test_each_fault_has_its_code_and_the_valid_row_passes(spark, stored):
    found = codes(spark, stored, [VALID] + [{**VALID, **fault} for fault, _ in FAULTS])
    assert found == [None] + [code for _, code in FAULTS]


def test_the_earlier_rule_wins(spark, stored):
    pairs = []
    for i, (first, code) in enumerate(FAULTS):
        for second, _ in FAULTS[i + 1 :]:
            if not set(first) & set(second):
                pairs.append(({**VALID, **first, **second}, code))
    assert len(pairs) > 200
    assert codes(spark, stored, [record for record, _ in pairs]) == [code for _, code in pairs]


@pytest.mark.parametrize("name", [n for n in VALID if n != "citation_view"])
def test_nothing_missing_passes(spark, stored, name):
    assert codes(spark, stored, [{**VALID, name: None}])[0] is not None


def test_oversized_snapshot(spark, stored):
    assert codes(spark, stored, [VALID], max_bytes=10)[0] == ENVELOPE
    assert codes(spark, stored, [{**VALID, "byte_length": 5}], max_bytes=10)[0] == "SNAPSHOT_TOO_LARGE"


def test_html_candidates(spark):
    html = "<!doctype html><body><p>Before. Nine barges <b>crossed</b> at dawn!</p><p>After.</p></body>"
    sha = hashlib.sha256(html.encode()).hexdigest()
    text, _ = render_html(html)
    view_sha = hashlib.sha256(text.encode()).hexdigest()

    def view(source=sha, digest=view_sha):
        return ("DerivedCitationView", "html-text@1", source, "text/plain; charset=utf-8", digest, len(text))

    record = {**VALID, "media_type": "text/html; charset=utf-8", "sha256": sha, "byte_length": len(html),
              "exact": QUOTE, "suffix": "\nAfter.", "citation_view": view()}
    snapshots = spark.createDataFrame([("s1", html)], "snapshot_ref string, content string")
    views = html_text_views(snapshots.withColumn("sha256", F.sha2("content", 256)))
    records = [record, {**record, "citation_view": None}, {**record, "citation_view": view(source=SHA)},
               {**record, "citation_view": view(digest=SHA)}]
    assert codes(spark, snapshots, records, views=views) == [
        None, "CITATION_VIEW_INVALID", "CITATION_VIEW_INVALID", "CITATION_VIEW_HASH_MISMATCH"]
    assert codes(spark, snapshots, [record])[0] == "HTML_PARSE_FAILED"


def test_evidence_envelope(spark, stored):
    frame = spark.createDataFrame([tuple(VALID.values())], SCHEMA).withColumn("evidence_id", F.lit("e1"))
    evidence = frame.withColumn("kind", F.lit("VerifiedEvidence"))
    assert gate.envelope_validate(evidence, gate.EVIDENCE_KIND).first().failure_code is None
    early = evidence.withColumn("verified_at", F.lit("2026-01-01T00:00:00Z"))
    assert gate.envelope_validate(early, gate.EVIDENCE_KIND).first().failure_code == "TIMESTAMP_ORDER_INVALID"
