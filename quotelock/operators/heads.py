"""Heads of collections and histories: digests of canonical JSON, streamed over ordered rows.

A head commits to every record of a chain. It is taken while the chain's rows pass in order:
one digest per array is kept open, and a copy of it is closed wherever a head is wanted, so
no array is gathered and the heads of all prefixes of a chain cost one pass over it. The
digests of one chain depend on each other, so a chain is one task; its memory is a batch.

* ``index_sha256``: the index record with its entries,
* ``packets_sha256``: the list of packet names and contents,
* ``audit_sha256``: the receipt of a verified audit of that index,
* ``bundle_sha256``: a record of these three, the head of a collection,
* ``history_sha256`` and ``lineage_sha256``: the same for the transition entries, and for
  collection, history and its audit together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelock.functions.digests import canonical_digest, canonical_json, canonical_split

_ASSURANCE = '"assurance":{"timestamp":"not-attested"}'
INDEX_KIND = "EvidencePacketIndex"
AUDIT_KIND = "EvidencePacketCollectionAuditReceipt"
BUNDLE_KIND = "EvidencePacketCollectionBundle"
HISTORY_KIND = "EvidencePacketTransitionHistoryIndex"
HISTORY_AUDIT_KIND = "EvidencePacketTransitionHistoryAuditReceipt"
LINEAGE_KIND = "EvidencePacketCollectionLineageBundle"
CONTINUITY = (
    ("previous_bundle_sha256", "next_bundle_sha256"),
    ("previous_index_sha256", "next_index_sha256"),
    ("previous_packet_count", "next_packet_count"),
)

Rows = Iterator[pa.RecordBatch]


class OpenArray:
    """A digest of a JSON text that ends with an array, open for more items."""

    def __init__(self, start: str, end: str) -> None:
        self.digest, self.end, self.empty = hashlib.sha256(f"{start}[".encode()), f"]{end}".encode(), True

    def add(self, item: str) -> None:
        self.digest.update((item if self.empty else f",{item}").encode())
        self.empty = False

    def closed(self) -> str:
        copy = self.digest.copy()
        copy.update(self.end)
        return copy.hexdigest()


def index_array(namespace: str, kind: str) -> OpenArray:
    return OpenArray(f'{{{_ASSURANCE},"entries":', f',"kind":"{namespace}{kind}","version":1}}')


class ChainCheck:
    """Places, links and digests of one chain's rows, as they pass."""

    def __init__(self) -> None:
        self.place, self.entry, self.code, self.broken = 0, None, None, None

    def add(self, sequence: int | None, link: str | None, entry: str | None, before: str | None, after: str | None) -> bool:
        """Whether the chain is whole up to this row."""
        value = "null" if link is None else f'"{link}"'
        text = None if before is None or after is None else f"{before}{value}{after}"
        code = None
        if sequence is None or sequence > self.place + 1 or sequence < 1:
            code = "SEQUENCE_GAP"
        elif sequence <= self.place:
            code = "SEQUENCE_DUPLICATE"
        elif link != self.entry:
            code = "LINK_MISMATCH"
        elif text is None or entry != hashlib.sha256(text.encode()).hexdigest():
            code = "HASH_MISMATCH"
        if self.code is None and code is not None:
            self.code, self.broken = code, sequence
        self.place, self.entry = sequence if sequence is not None else self.place, entry
        return self.code is None


class CollectionFold:
    """Heads of a collection up to each of its packets."""

    def __init__(self, namespace: str) -> None:
        self.check, self.count, self.bytes, self.first, self.last = ChainCheck(), 0, 0, None, None
        self.index, self.packets = index_array(namespace, INDEX_KIND), OpenArray("", "")

    def heads(self) -> tuple:
        if not self.count or self.check.code is not None:
            return (None,) * 6
        return self.index.closed(), self.packets.closed(), self.count, self.bytes, self.first, self.last

    def add(self, row: Mapping) -> None:
        self.check.add(row["sequence"], row["link"], row["entry"], row["before"], row["after"])
        self.count += 1
        if row["size"] is None or row["item"] is None or row["packet"] is None:
            self.check.code = self.check.code or "HASH_MISMATCH"
        if self.check.code is None:
            self.index.add(row["item"])
            self.packets.add(row["packet"])
            self.bytes += row["size"]
            self.first, self.last = self.first or row["sha256"], row["sha256"]


HEAD_COLUMNS = ("index_sha256", "packets_sha256", "packet_count", "total_source_bytes", "first_packet_sha256", "last_packet_sha256")
_HEAD_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _grouped(batches: Rows, width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[dict]]]:
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
        yield batch, keys, batch.select(batch.schema.names[width:]).to_pylist()


def _prefix_batches(width: int, namespace: str) -> Callable[[Rows], Rows]:
    """A row per entry: its collection's heads with it, and without it."""

    def run(batches: Rows) -> Rows:
        current, fold = None, CollectionFold(namespace)
        for batch, keys, rows in _grouped(batches, width):
            found = []
            for key, row in zip(keys, rows, strict=True):
                if key != current:
                    current, fold = key, CollectionFold(namespace)
                before = fold.heads()
                fold.add(row)
                found.append((row["sequence"], row["sha256"], *fold.heads(), *before, fold.check.code))
            types = (pa.int64(), pa.string(), *_HEAD_TYPES, *_HEAD_TYPES, pa.string())
            arrays = [pa.array(list(values), kind) for values, kind in zip(zip(*found, strict=True), types, strict=True)]
            names = ["sequence", "packet_sha256", *HEAD_COLUMNS, *(f"previous_{name}" for name in HEAD_COLUMNS), "failure_code"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=[*batch.schema.names[:width], *names])

    return run


def _last_batches(width: int, fold_of: Callable[[], object], summary: Callable[[object], tuple], schema: pa.Schema) -> Callable[[Rows], Rows]:
    """A row per chain, when its last row has passed."""

    def run(batches: Rows) -> Rows:
        current, fold, names = None, None, []
        for batch, keys, rows in _grouped(batches, width):
            names, found = batch.schema, []
            for key, row in zip(keys, rows, strict=True):
                if fold is None or key != current:
                    if fold is not None:
                        found.append((*current, *summary(fold)))
                    current, fold = key, fold_of()
                fold.add(row)
            if found:
                yield _summaries(found, names, width, schema)
        if fold is not None:
            yield _summaries([(*current, *summary(fold))], names, width, schema)

    return run


def _summaries(found: list[tuple], names: pa.Schema, width: int, schema: pa.Schema) -> pa.RecordBatch:
    fields = [names.field(i) for i in range(width)] + list(schema)
    arrays = [pa.array(list(values), field.type) for values, field in zip(zip(*found, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[field.name for field in fields])


def _ordered(rows: DataFrame, chain: Sequence[str]) -> DataFrame:
    return rows.repartition(*chain).sortWithinPartitions(*chain, "sequence")


def _packet_rows(entries: DataFrame, chain: Sequence[str]) -> DataFrame:
    from quotelock.operators.lineage import packet_payload

    c = F.col
    payload = packet_payload()
    before, after = canonical_split(payload, "previousEntrySha256")
    item = canonical_json({**payload, "previousEntrySha256": c("previous_entry_sha256"), "entrySha256": c("entry_sha256")})
    packet = canonical_json(
        {
            "name": F.concat(F.lit("packets/"), c("packet_sha256"), F.lit(".json")),
            "packetSha256": c("packet_sha256"),
            "sourceByteLength": c("source_byte_length"),
            "sourceSha256": c("source_sha256"),
        }
    )
    return entries.select(
        *chain,
        c("sequence").cast("bigint").alias("sequence"),
        c("previous_entry_sha256").alias("link"),
        c("entry_sha256").alias("entry"),
        before.alias("before"),
        after.alias("after"),
        item.alias("item"),
        packet.alias("packet"),
        c("packet_sha256").alias("sha256"),
        c("source_byte_length").cast("bigint").alias("size"),
    )


def audit_head(namespace: str, side: str = "") -> Column:
    """Head of the receipt of a verified audit of the index on ``side``."""
    c = lambda name: F.col(f"{side}{name}")
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}{AUDIT_KIND}"),
            "outcome": F.lit("verified"),
            "index": {"indexSha256": c("index_sha256"), "packetCount": c("packet_count")},
            "coverage": {
                "firstPacketSha256": c("first_packet_sha256"),
                "lastPacketSha256": c("last_packet_sha256"),
                "totalSourceBytes": c("total_source_bytes"),
            },
            "assurance": {"timestamp": F.lit("not-attested")},
        }
    )


def bundle_head(namespace: str, side: str = "") -> Column:
    """The one head of a collection: of its index, its audit receipt and its packets.

    The receipt's head is a column already, so that its text is not written out again.
    """
    index = F.col(f"{side}index_sha256")
    digest = canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}{BUNDLE_KIND}"),
            "indexSha256": index,
            "auditSha256": F.col(f"{side}audit_sha256"),
            "packetsSha256": F.col(f"{side}packets_sha256"),
            "assurance": {"timestamp": F.lit("not-attested")},
        }
    )
    return F.when(index.isNotNull(), digest)


def _schema(frame: DataFrame, chain: Sequence[str], names: Sequence[str]) -> T.StructType:
    numbers = ("sequence", "count", "bytes")
    kind = lambda name: T.LongType() if name.endswith(numbers) else T.StringType()
    return T.StructType([frame.schema[name] for name in chain] + [T.StructField(name, kind(name)) for name in names])


def prefix_heads(entries: DataFrame, chain: Sequence[str], namespace: str = "Quotelock") -> DataFrame:
    """One row per entry: the heads of the collection that ends with it, and (``previous_``) before it.

    From the first entry on that is missing, repeated, out of place or damaged, heads are
    NULL and ``failure_code`` says what was wrong first.
    """
    rows = _packet_rows(entries, chain)
    names = ["sequence", "packet_sha256", *HEAD_COLUMNS, *(f"previous_{name}" for name in HEAD_COLUMNS), "failure_code"]
    folded = _ordered(rows, chain).mapInArrow(_prefix_batches(len(chain), namespace), _schema(rows, chain, names))
    return _with_bundles(folded, namespace, ("", "previous_"))


def _with_bundles(rows: DataFrame, namespace: str, sides: Sequence[str]) -> DataFrame:
    there = lambda side: F.col(f"{side}index_sha256").isNotNull()
    audited = rows.withColumns({f"{side}audit_sha256": F.when(there(side), audit_head(namespace, side)) for side in sides})
    return audited.withColumns({f"{side}bundle_sha256": bundle_head(namespace, side) for side in sides})


def collection_heads(entries: DataFrame, chain: Sequence[str], namespace: str = "Quotelock") -> DataFrame:
    """One row per collection: entries, last link, heads and the first fault of its chain.

    ``entry_count`` counts all rows; heads are NULL where ``failure_code`` is not.
    """
    rows = _packet_rows(entries, chain)
    names = ["entry_count", "head_sha256", "broken_sequence", "failure_code", *HEAD_COLUMNS]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), *_HEAD_TYPES)
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def summary(fold: CollectionFold) -> tuple:
        return fold.count, fold.check.entry, fold.check.broken, fold.check.code, *fold.heads()

    run = _last_batches(len(chain), lambda: CollectionFold(namespace), summary, schema)
    folded = _ordered(rows, chain).mapInArrow(run, _schema(rows, chain, names))
    return _with_bundles(folded, namespace, ("",))


class HistoryFold:
    """Chain, continuity and head of a transition history."""

    def __init__(self, namespace: str) -> None:
        self.check, self.count, self.continuity, self.last = ChainCheck(), 0, None, None
        self.index = index_array(namespace, HISTORY_KIND)

    def add(self, row: Mapping) -> None:
        self.check.add(row["sequence"], row["link"], row["entry"], row["before"], row["after"])
        self.count += 1
        self.index.add(row["item"] or "")
        last = self.last
        if self.continuity is None and last is not None:
            if any(row[name] is None or row[name] != last[earlier] for name, earlier in CONTINUITY):
                self.continuity = "HISTORY_CONTINUITY_MISMATCH"
        self.last = row


def history_heads(history: DataFrame, chain: Sequence[str], namespace: str = "Quotelock") -> DataFrame:
    """One row per history: entries, faults of chain and continuity, its end and its head."""
    from quotelock.operators.lineage import transition_payload

    c = F.col
    payload = transition_payload()
    before, after = canonical_split(payload, "previousEntrySha256")
    item = canonical_json({**payload, "previousEntrySha256": c("previous_entry_sha256"), "entrySha256": c("entry_sha256")})
    values = list(dict.fromkeys(name for pair in CONTINUITY for name in pair))
    rows = history.select(
        *chain, c("sequence").cast("bigint").alias("sequence"), c("previous_entry_sha256").alias("link"),
        c("entry_sha256").alias("entry"), before.alias("before"), after.alias("after"), item.alias("item"), *values,
    )
    names = ["transition_count", "history_code", "continuity_code", "next_bundle_sha256", "next_packet_count", "history_sha256"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def summary(fold: HistoryFold) -> tuple:
        end = fold.last["next_bundle_sha256"], fold.last["next_packet_count"]
        return fold.count, fold.check.code, fold.continuity, *end, fold.index.closed()

    run = _last_batches(len(chain), lambda: HistoryFold(namespace), summary, schema)
    return _ordered(rows, chain).mapInArrow(run, _schema(rows, chain, names))


def lineage_head(namespace: str = "Quotelock") -> Column:
    """Head of a lineage: of its collection, its history and the receipt of the history's audit."""
    c = F.col
    audit = canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}{HISTORY_AUDIT_KIND}"),
            "outcome": F.lit("verified"),
            "history": {"indexSha256": c("history_sha256"), "transitionCount": c("transition_count")},
            "assurance": {"timestamp": F.lit("not-attested")},
        }
    )
    return canonical_digest(
        {
            "version": F.lit(1),
            "kind": F.lit(f"{namespace}{LINEAGE_KIND}"),
            "bundleSha256": c("bundle_sha256"),
            "historySha256": c("history_sha256"),
            "historyAuditSha256": audit,
            "assurance": {"timestamp": F.lit("not-attested")},
        }
    )
