"""Repeated word sequences by FM-indexes over shards.

A window is a fixed number of consecutive words. Its anchor is its least word gram under a
hash, so equal windows have equal anchors; consecutive windows with one anchor are one
segment. Anchors met in one document only cannot hold a repeated window and are left out.
The other segments go to the shard of their anchor, equal ones as one. Each shard is
indexed and its own segments are searched in it: matches as long as a window, and the
least document that has them. What comes back to a document are its windows that also
start in a document with a smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import Roller, buffer, find_words, mixed, slices
from quotelock.llm.fmindex import FMIndex
from quotelock.llm.staging import staged

WINDOW = 13
GRAM = 4
#: Bits of the tables of shared anchors and of documents that lose words. They only save
#: work: what they let through by chance meets nothing in the joins that follow.
TABLE_BITS = 1 << 25
#: Words that one shard indexes, about.
SHARD_WORDS = 1 << 20
#: Different segments of one anchor beyond which they are cut to windows and spread.
HOT_SEGMENTS = 1 << 12


class Segments:
    """Segments of the texts of one slice."""

    def __init__(self, column: pa.Array, window: int) -> None:
        self.words = find_words(*buffer(column))
        hashes = self.words.hashes()
        ends = np.repeat(self.words.first[1:], self.words.counts)
        windows = np.flatnonzero(np.arange(len(hashes)) + window <= ends)
        self.hashes = hashes
        if not len(windows):
            self.first = self.counts = self.owner = np.empty(0, np.int64)
            self.anchors = np.empty(0, np.uint64)
            return
        roller = Roller(hashes)
        size = min(GRAM, window)
        grams = mixed(roller.windows(np.arange(len(hashes) - size + 1), size))
        least, place = grams[windows], windows.copy()
        for step in range(1, window - size + 1):
            other = grams[windows + step]
            lower = other < least
            least = np.where(lower, other, least)
            place = np.where(lower, windows + step, place)
        owner = self.words.owner()[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.first, self.anchors, self.owner = windows[at], least[at], owner[at]
        self.counts = np.diff(np.append(at, len(windows)))


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                found = Segments(batch.column(0).slice(start, stop - start), window)
                order = np.lexsort((found.anchors, found.owner))
                anchors, owner = found.anchors[order], found.owner[order]
                new = np.ones(len(order), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64))], names=["anchor"])

    return run


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.unique(mixed(batch.column(0).to_numpy().view(np.uint64), 2) % np.uint64(TABLE_BITS))
        cells, first = np.unique(slots >> np.uint64(5), return_index=True)
        values = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(31)), first) if len(first) else slots
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.astype(np.int64)), pa.array(values.astype(np.int64))], names=["cell", "bits"]
        )


def bit_table(values: DataFrame) -> np.ndarray:
    """A bit for every value of a ``bigint`` column, combined before it reaches the driver."""
    cells = values.mapInArrow(_cell_rows, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    found = cells.toArrow()
    table = np.zeros(TABLE_BITS // 32, np.uint32)
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def set_bits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = mixed(values, 2) % np.uint64(TABLE_BITS)
    return (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & 1).astype(bool)


def _segment_rows(shared, window: int):
    names = ["key", "text_hash", "start", "anchor", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                found = Segments(part.column(2), window)
                kept = np.flatnonzero(set_bits(table, found.anchors))
                if not len(kept):
                    continue
                first, counts, owner = found.first[kept], found.counts[kept], found.owner[kept]
                raw = found.words.data.tobytes()
                starts, ends = found.words.starts[first], found.words.ends[first + counts + window - 2]
                texts = [b" ".join(raw[a:b].split()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                rows = pa.array(owner)
                columns = [
                    part.column(0).take(rows), part.column(1).take(rows),
                    pa.array((first - found.words.first[owner]).astype(np.int64)),
                    pa.array(found.anchors[kept].view(np.int64)), pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _search_shards(window: int):
    """Per segment of a shard: the least key that has each of its windows."""
    names = ["anchor", "content", "at", "least"]

    def search(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        numbers: dict[bytes, int] = {}
        lists = [[numbers.setdefault(word, len(numbers)) for word in text.split()] for text in table.column("words").to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in lists])])
        index = FMIndex(np.fromiter((word for words in lists for word in words), np.int64, int(bounds[-1])), bounds)
        del lists, numbers
        counts = np.diff(bounds) - window + 1
        at = np.concatenate([[0], np.cumsum(counts)])
        starts = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], counts)
        keys = table.column("least").to_numpy()
        least = index.least(*index.find(starts, window), keys)
        matched = np.minimum(least, np.repeat(keys, counts))
        useful = np.flatnonzero(np.minimum.reduceat(matched, at[:-1]) < table.column("most").to_numpy())
        found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(matched))
        kept = table.take(pa.array(useful))
        for start in range(0, len(useful), 4096):
            part = slice(start, start + 4096)
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(name).combine_chunks().slice(start, 4096) for name in names[:3]), found.take(pa.array(useful[part]))],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                size += batch.num_rows
        if size:
            yield from search(rows)

    return run


def _without_places(texts: list, places: list, window: int) -> list[pa.Array]:
    """Word counts, removed words and kept text of each text without its covered words."""
    rows = []
    for text, starts in zip(texts, places, strict=True):
        words = (text or "").encode().split()
        if not starts:
            rows.append((len(words), 0, b" ".join(words).decode()))
            continue
        gone = np.zeros(len(words) + 1, np.int64)
        starts = np.unique(np.asarray(starts, np.int64))
        gone[starts] += 1
        np.subtract.at(gone, starts + window, 1)
        left = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        rows.append((len(words), len(words) - len(left), b" ".join(left).decode()))
    return [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]


_REMOVED = ["key", "n_words", "n_removed", "kept"]


def _touched_rows(shared):
    """Rows with a set bit: only documents that may lose words move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(set_bits(shared.value, batch.column(3).to_numpy().view(np.uint64)))
            for start in range(0, len(rows), 256):
                yield batch.take(pa.array(rows[start : start + 256])).select([0, 1, 2])

    return run


def _whole_rows(shared, window: int):
    """Results of the rows without a set bit, which lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clear = ~set_bits(shared.value, batch.column(3).to_numpy().view(np.uint64))
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start).filter(pa.array(clear[start:stop]))
                texts = part.column(2).to_pylist()
                columns = _without_places(texts, [None] * len(texts), window)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=_REMOVED)

    return run


def _removal_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                columns = _without_places(part.column(1).to_pylist(), part.column(2).to_pylist(), window)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=_REMOVED)

    return run


def repeated_windows(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(key, text_hash, places)``: words at which repeated windows start, per document.

    ``source`` has key, text_hash and text; documents without such a window are not there.
    """
    spark = source.sparkSession
    anchors = source.select("text").mapInArrow(_anchor_rows(window), "anchor bigint")
    met_again = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    shared = spark.sparkContext.broadcast(bit_table(met_again))
    segments = staged(
        source.mapInArrow(
            _segment_rows(shared, window),
            "key bigint, text_hash bigint, start bigint, anchor bigint, words binary",
        ).withColumn("content", F.xxhash64("words")),
        "segments",
    )
    contents = staged(
        segments.groupBy("anchor", "words")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"))
        .withColumns({"content": F.xxhash64("words"), "windows": F.size(F.split(F.col("words").cast("string"), " ")) - (window - 1)}),
        "segment-contents",
    )
    size = contents.agg(F.coalesce(F.sum(F.col("windows") + window - 1), F.lit(0)).alias("words")).first()["words"]
    hot = staged(
        contents.groupBy("anchor").count().where(F.col("count") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot")),
        "hot-anchors",
    )
    marked = contents.join(hot, "anchor", "left")
    whole = marked.where("hot is null").select(
        "anchor", "content", F.lit(0).cast("bigint").alias("at"), "words", "least", "most",
        F.lit(False).alias("cut"),
    )
    split = F.split(F.col("words").cast("string"), " ")
    cut = marked.where("hot").select(
        "anchor", "content", "least", "most", split.alias("list"), F.explode(F.sequence(F.lit(0), F.col("windows").cast("int") - 1)).alias("at"),
    )
    cut = cut.select(
        "anchor", "content", F.col("at").cast("bigint").alias("at"),
        F.array_join(F.slice("list", F.col("at") + 1, window), " ").cast("binary").alias("words"), "least", "most",
    ).withColumn("cut", F.lit(True))
    shards = max(1, -(-size // SHARD_WORDS))
    shard = F.when(F.col("cut"), F.xxhash64("words")).otherwise(F.col("anchor"))
    indexed = whole.union(cut).repartition(shards, shard).drop("cut")
    matches = staged(
        indexed.mapInArrow(_search_shards(window), "anchor bigint, content bigint, at bigint, least array<bigint>"),
        "window-matches",
    )
    found = (
        segments.select("key", "text_hash", "start", "anchor", "content")
        .join(matches, ["anchor", "content"])
        .select("key", "text_hash", "start", "at", F.posexplode("least").alias("step", "least"))
        .where("least < key")
        .select("key", "text_hash", (F.col("start") + F.col("at") + F.col("step")).alias("place"))
    )
    return found.groupBy("key", "text_hash").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_removed`` and the ``kept`` words as text.

    A word goes when a window covers it whose words also start in a row with a smaller
    key, judged on the input. NULL text counts as empty, a NULL key as the greatest, and
    rows of one key do not take words from each other. Other columns are ignored.
    """
    greatest = F.lit((1 << 63) - 1)
    source = docs.select(
        F.coalesce(F.col(key).cast("bigint"), greatest).alias("key"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"),
        F.col(text).cast("string").alias("text"),
    )
    places = staged(repeated_windows(source, window), "repeated-places")
    table = bit_table(places.select(F.xxhash64("key", "text_hash").alias("value")))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    marked = source.select("key", "text_hash", "text", F.xxhash64("key", "text_hash").alias("value"))
    kinds = "key bigint, text_hash bigint, text string"
    removed = "key bigint, n_words bigint, n_removed bigint, kept string"
    touched = (
        marked.mapInArrow(_touched_rows(shared), kinds)
        .join(places, ["key", "text_hash"], "left")
        .select("key", "text", "places")
        .mapInArrow(_removal_rows(window), removed)
    )
    whole = marked.mapInArrow(_whole_rows(shared, window), removed)
    return touched.union(whole).select(F.when(F.col("key") != greatest, F.col("key")).alias(key), "n_words", "n_removed", "kept")
