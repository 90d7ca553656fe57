"""Streams over several batches, and batches that are run again."""

import hashlib

from quotelock.operators.chains import chain_build, chain_verify
from quotelock.operators.lineage import packet_payload
from quotelock.streaming import appends

PACKET = (
    "collection_id bigint, sequence bigint, packet_sha256 string, source_sha256 string, "
    "source_byte_length bigint, candidate_id string, evidence_id string"
)


def packet(collection, sequence, tag="", size=10):
    head = hashlib.sha256(f"{collection}-{sequence}{tag}".encode()).hexdigest()
    return (collection, sequence, head, head, size, f"c{head}", f"e{head}")


def write_batches(spark, path, batches, schema):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{number}")


def stream(spark, path, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(path)


def test_chains_over_batches(spark, tmp_path):
    batches = [
        [packet(1, 1), packet(1, 2), packet(2, 1), packet(3, 2)],
        [packet(1, 3), packet(1, 2, "late"), packet(2, 2), packet(2, 2, "fork"), packet(3, 1)],
        [packet(1, 4), packet(1, 5), packet(1, 7), packet(2, 3), packet(3, 2, "new")],
        [packet(1, 6), packet(2, 2)],
    ]
    write_batches(spark, f"{tmp_path}/in", batches, PACKET)
    query = appends.stream_chain_append(
        stream(spark, f"{tmp_path}/in", PACKET), f"{tmp_path}/rows", f"{tmp_path}/state", max_entries=5
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/rows")
    kept = rows.where("failure_code IS NULL")
    assert {(r.collection_id, r.sequence) for r in kept.collect()} == {
        (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 2), (3, 1), (3, 2)}
    assert rows.count() == sum(map(len, batches))
    assert all(r.failure_code is None for r in chain_verify(kept, ["collection_id"], packet_payload()).collect())
    plain = chain_build(
        kept.select("collection_id", "sequence", "packet_sha256", "source_sha256", "source_byte_length",
                    "candidate_id", "evidence_id"),
        ["collection_id"], packet_payload(),
    )
    assert {r.entry_sha256 for r in plain.collect()} == {r.entry_sha256 for r in kept.collect()}


def test_rejections_keep_their_code(spark):
    stored = spark.createDataFrame([], appends.ENTRY_SCHEMA)
    first = appends.append_batch(
        spark.createDataFrame([packet(1, 1), packet(1, 2), packet(1, 4), packet(2, 1), packet(2, 1, "fork")], PACKET),
        stored,
    )
    codes = sorted((r.collection_id, r.sequence, r.failure_code) for r in first.collect())
    assert codes == [(1, 1, None), (1, 2, None), (1, 4, "PACKET_APPEND_GAP"),
                     (2, 1, "PACKET_APPEND_FORK"), (2, 1, "PACKET_APPEND_FORK")]
    kept = spark.createDataFrame(first.collect(), appends.ENTRY_SCHEMA)
    again = packet(1, 1)
    second = appends.append_batch(
        spark.createDataFrame([packet(1, 2, "x"), (1, 3, *again[2:]), packet(1, 4)], PACKET), kept
    )
    assert sorted((r.sequence, r.failure_code) for r in second.collect()) == [
        (2, "PACKET_APPEND_STALE"), (3, "PACKET_INDEX_DUPLICATE"), (4, "PACKET_APPEND_GAP")]
    heavy = appends.append_batch(
        spark.createDataFrame([packet(1, 3, size=40), packet(1, 4, size=60)], PACKET), kept, max_bytes=100
    )
    assert sorted((r.sequence, r.failure_code) for r in heavy.collect()) == [
        (3, None), (4, "PACKET_COLLECTION_BYTES_EXCEEDED")]


def test_content_is_stored_once(spark, tmp_path):
    schema = "snapshot_ref string, sha256 string"
    batches = [[("a", "1"), ("b", "1"), ("c", "2")], [("d", "2"), ("e", "3")], [("f", "1"), ("g", "3")]]
    write_batches(spark, f"{tmp_path}/in", batches, schema)
    for _ in range(2):
        query = appends.stream_dedupe(
            stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/rows", f"{tmp_path}/state"
        )
        query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert sorted(r.sha256 for r in rows) == ["1", "2", "3"]


def test_a_batch_costs_what_its_own_rows_cost(spark, tmp_path):
    """Ten batches: state is touched for the batch's keys alone, and no batch reads the store."""
    batches = [[packet(chain, number + 1) for chain in range(20)] for number in range(10)]
    write_batches(spark, f"{tmp_path}/in", batches, PACKET)
    query = appends.stream_chain_append(stream(spark, f"{tmp_path}/in", PACKET), f"{tmp_path}/rows", f"{tmp_path}/state")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 10
    touched = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert len(set(touched[1:])) == 1
    assert all("rows" not in str(source["description"]).rsplit("/", 1)[-1] for p in progress for source in p["sources"])
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.where("failure_code is null").count() == 200
    plain = chain_build(
        spark.createDataFrame([row for batch in batches for row in batch], PACKET), ["collection_id"], packet_payload()
    )
    columns = ["collection_id", "sequence", "previous_entry_sha256", "entry_sha256"]
    assert sorted(map(tuple, rows.select(*columns).collect()), key=str) == sorted(map(tuple, plain.select(*columns).collect()), key=str)


def test_stream_equals_batches(spark, tmp_path):
    """Random packets with NULLs, repeats and forks: the stream's rows are those of the batch operator."""
    import random

    random.seed(4)
    pool = [packet(chain, number, tag) for chain in (1, 2, 3, None) for number in range(1, 6) for tag in ("", "x")]
    batches = []
    for _ in range(4):
        rows = random.sample(pool, 14)
        rows += [(rows[0][0], rows[0][1] + 1, *rows[0][2:]), (2, None, *rows[1][2:]), (1, 2, None, *rows[2][3:])]
        batches.append(rows)
    batches[0] += [packet(1, 1), packet(1, 2), packet(2, 1)]
    write_batches(spark, f"{tmp_path}/in", batches, PACKET)
    limits = {"max_entries": 4, "max_bytes": 35}
    appends.stream_chain_append(
        stream(spark, f"{tmp_path}/in", PACKET), f"{tmp_path}/rows", f"{tmp_path}/state", **limits
    ).awaitTermination()
    stored = []
    for batch in batches:
        known = spark.createDataFrame(stored, appends.ENTRY_SCHEMA)
        stored += appends.append_batch(spark.createDataFrame(batch, PACKET), known, **limits).collect()
    columns = [name.split()[0] for name in appends.ENTRY_SCHEMA.split(", ")]
    got = spark.read.parquet(f"{tmp_path}/rows").select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(row[name] for name in columns)) for row in stored)
    assert {"PACKET_INDEX_INVALID", "PACKET_APPEND_STALE"} <= {row["failure_code"] for row in got}
