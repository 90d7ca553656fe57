"""Keyed state of the streams: content seen before, and the chains as they stand.

State lives in Spark's state store, by key: a batch touches the keys of its own rows and
nothing else, however much has been stored. State changes and output rows of a batch are
committed together, so a batch that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the state store that keeps several kinds of state per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FirstSeen(StatefulProcessor):
    """Emit each key once, with the least of ``value`` among the rows that brought it."""

    def __init__(self, key: str, value: str) -> None:
        self.key, self.value = key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        values = [row[self.value] for row in rows if row[self.value] is not None]
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(**{self.key: key[0], self.value: min(values, default=None)})

    def close(self) -> None:
        pass


class ChainAppender(StatefulProcessor):
    """Append the rows of a chain to its head; rows that do not continue it get a code.

    Value state holds the head (sequence, digest, bytes), map state every identity of the
    entries. Rows bring ``_before`` and ``_after``, the canonical text around their link. The
    rows of one chain in one batch are held at once; those of earlier batches are not.
    """

    def __init__(
        self,
        chain: Sequence[str],
        columns: Sequence[str],
        identities: Sequence[str],
        max_entries: int | None = None,
        max_bytes: int | None = None,
    ) -> None:
        self.chain, self.columns, self.identities = list(chain), list(columns), list(identities)
        self.max_entries, self.max_bytes = max_entries, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sequence bigint, digest string, bytes bigint")
        self.known = handle.getMapState("identities", "identity string", "sequence bigint")

    def _is_fresh(self, row: Row, first: dict[tuple[str, str], int]) -> bool:
        for name in self.identities:
            value = row[name]
            if value is None or first.get((name, value)) != row["sequence"] or self.known.containsKey((f"{name}:{value}",)):
                return False
        return True

    def _codes(self, rows: list[Row], head: int, stored: int) -> Iterator[tuple[Row, str | None]]:
        """Every row, in order of sequence, with the first rule that it breaks by itself."""
        claims = Counter(row["sequence"] for row in rows)
        first: dict[tuple[str, str], int] = {}
        for row in rows:
            for name in self.identities:
                if row["sequence"] is not None:
                    first.setdefault((name, row[name]), row["sequence"])
        total = stored
        for row in rows:
            place, size = row["sequence"], row["source_byte_length"]
            after = place is not None and place > head
            total += (size or 0) if after else 0
            if not after:
                code = "PACKET_APPEND_STALE"
            elif claims[place] != 1:
                code = "PACKET_APPEND_FORK"
            elif not self._is_fresh(row, first):
                code = "PACKET_INDEX_DUPLICATE"
            elif self.max_entries is not None and place > self.max_entries:
                code = "PACKET_INDEX_FULL"
            elif self.max_bytes is not None and total > self.max_bytes:
                code = "PACKET_COLLECTION_BYTES_EXCEEDED"
            else:
                code = None
            yield row, code

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        place, digest, size = self.head.get() if self.head.exists() else (0, None, 0)
        # Rows without a sequence come first, as in the batch operator's running total.
        ordered = sorted(rows, key=lambda row: (row["sequence"] is not None, row["sequence"] or 0, row["packet_sha256"] or ""))
        start, accepted = place, []
        for row, code in list(self._codes(ordered, start, size)):
            link = entry = None
            if code is None and row["sequence"] != place + 1:
                code = "PACKET_APPEND_GAP"
            if code is None:
                link = digest
                value = "null" if link is None else f'"{link}"'
                digest = entry = hashlib.sha256(f"{row['_before']}{value}{row['_after']}".encode()).hexdigest()
                place, size = row["sequence"], size + (row["source_byte_length"] or 0)
                accepted.append(row)
            kept = dict(zip(self.chain, key)) | {name: row[name] for name in self.columns}
            yield Row(**kept, previous_entry_sha256=link, entry_sha256=entry, failure_code=code)
        for row in accepted:
            for name in self.identities:
                self.known.updateValue((f"{name}:{row[name]}",), (row["sequence"],))
        if place > start:
            self.head.update((place, digest, size))

    def close(self) -> None:
        pass
