"""Benchmark leaks by greedy string tiling.

Windows of a few tokens of all benchmark items are seeds. A bitmap of fixed size tells
which documents can hold any; their seeds meet the items' by an equi join. Each pair is
tiled: the longest matches of unmarked tokens are found by running Karp-Rabin hashes and
marked, again and again with shorter ones, so passages in any order count. A pair is
reported when the tiles cover enough of the item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import PLAIN, Roller, Words, buffer, find_words, mixed, slices
from quotelock.llm.staging import staged

TILE = 4
COVERAGE = 0.5
BITMAP_BITS = 1 << 23
PROBES = 3

def tokens(column: pa.Array) -> Words:
    """Lower-case runs of letters and digits; other ASCII characters separate them."""
    data, offsets = buffer(pc.utf8_lower(column.cast(pa.large_string())))
    return find_words(data, offsets, PLAIN)


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` tokens of which none is marked."""
    if length > len(marked):
        return np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def _shared(a: np.ndarray, i: int, a_marked: np.ndarray, b: np.ndarray, j: int, b_marked: np.ndarray) -> int:
    """Length of the match of unmarked tokens that starts at ``a[i]`` and ``b[j]``."""
    total, step = 0, 64
    while True:
        size = min(step, len(a) - i - total, len(b) - j - total)
        if size <= 0:
            return total
        x, y = slice(i + total, i + total + size), slice(j + total, j + total + size)
        differs = (a[x] != b[y]) | a_marked[x] | b_marked[y]
        if differs.any():
            return total + int(differs.argmax())
        total += size
        step *= 2


def tile(item: np.ndarray, doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, length), longest marked first.

    Longer matches always go before shorter ones; equal ones go by place in the item, then
    in the document. No token is in two tiles.
    """
    item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    item_roller, doc_roller = Roller(item), Roller(doc)
    found: list[tuple[int, int, int]] = []
    length = min(len(item), len(doc))
    while length >= least:
        places: dict[int, list[int]] = defaultdict(list)
        starts = _free_windows(item_marked, length)
        for start, value in zip(starts.tolist(), item_roller.windows(starts, length).tolist(), strict=True):
            places[value].append(start)
        starts = _free_windows(doc_marked, length)
        values = doc_roller.windows(starts, length)
        hits = np.isin(values, np.fromiter(places, np.uint64, len(places)))
        matches = []
        for j, value in zip(starts[hits].tolist(), values[hits].tolist(), strict=True):
            for i in places[value]:
                earlier = i and j and item[i - 1] == doc[j - 1] and not (item_marked[i - 1] or doc_marked[j - 1])
                if not earlier:
                    size = _shared(item, i, item_marked, doc, j, doc_marked)
                    if size >= length:
                        matches.append((-size, i, j))
        heapify(matches)
        while matches:
            size, i, j = heappop(matches)
            taken = item_marked[i : i - size] | doc_marked[j : j - size]
            if not taken.any():
                item_marked[i : i - size] = doc_marked[j : j - size] = True
                found.append((i, j, -size))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for start, stop in edges.reshape(-1, 2).tolist():
                if stop - start >= length:
                    heappush(matches, (start - stop, i + start, j + start))
        length = 0 if length == least else max(least, length // 2)
    return found


def _slots(seeds: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mixed(seeds, probe + 1) % np.uint64(bits) for probe in range(PROBES)])


def _seed_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                words = tokens(batch.column(1).slice(start, stop - start))
                places, seeds = words.windows(words.hashes(), least)
                row = batch.column(0).slice(start, stop - start).to_numpy()[words.owner()[places]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(seeds.view(np.int64))], names=["item_row", "seed"]
                )

    return run


def _slot_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(batch.column(0).to_numpy().view(np.uint64), bits))
            cells, first = np.unique(slots >> np.uint64(5), return_index=True)
            masks = np.uint64(1) << (slots & np.uint64(31))
            values = np.bitwise_or.reduceat(masks, first) if len(first) else masks
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int64)), pa.array(values.astype(np.int64))], names=["cell", "bits"]
            )

    return run


def seed_bitmap(seeds: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits over all seeds, combined before it reaches the driver."""
    cells = seeds.select("seed").mapInArrow(_slot_rows(bits), "cell bigint, bits bigint")
    merged = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).collect()
    bitmap = np.zeros(bits // 32, np.uint32)
    for row in merged:
        bitmap[row["cell"]] = row["bits"]
    return bitmap


def _candidates(bitmap, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bitmap.value
        for batch in batches:
            at = batch.num_columns - 1
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                words = tokens(part.column(at))
                places, seeds = words.windows(words.hashes(), least)
                hit = np.ones(len(seeds), bool)
                for slot in _slots(seeds, bits):
                    hit &= (cells[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1
                owner, seeds = words.owner()[places][hit], seeds[hit].view(np.int64)
                rows = np.unique(owner)
                if not len(rows):
                    continue
                lists = [np.unique(seeds[owner == row]) for row in rows] if len(rows) < 16 else [
                    np.unique(group) for group in np.split(seeds, np.flatnonzero(np.diff(owner)) + 1)
                ]
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(lists, pa.list_(pa.int64()))],
                    names=[f"c{i}" for i in range(part.num_columns)] + ["seeds"],
                )

    return run


def _tiled(least: int):
    names = ["n_tokens", "n_covered", "n_tiles", "longest_tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, items = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for start, stop in slices(docs):
                doc_words, item_words = (tokens(column.slice(start, stop - start)) for column in (docs, items))
                doc_hashes, item_hashes = doc_words.hashes(), item_words.hashes()
                rows = []
                for row in range(stop - start):
                    item = item_hashes[item_words.first[row] : item_words.first[row + 1]]
                    doc = doc_hashes[doc_words.first[row] : doc_words.first[row + 1]]
                    sizes = [size for _, _, size in tile(item, doc, least)]
                    rows.append((len(item), sum(sizes), len(sizes), max(sizes, default=0)))
                columns = [key.slice(start, stop - start) for key in keys]
                columns += [pa.array([row[i] for row in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(keys))] + names)

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    keys: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    least: int = TILE,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of a document and an item of which tiles cover at least ``coverage``.

    Columns: ``keys``, the item's id, and from the tiling ``n_tokens`` (of the item),
    ``n_covered``, ``n_tiles``, ``longest_tile`` and ``coverage``. NULL and empty texts, and
    items of fewer than ``least`` tokens, are in no pair. Repeated rows give repeated pairs;
    other columns are ignored. Seeds shared by many items cost one narrow row per pair,
    and pairs that cannot reach the coverage are dropped before texts are joined.
    """
    spark = docs.sparkSession
    items = staged(
        benchmark.select(
            F.monotonically_increasing_id().alias("item_row"),
            F.col(item).alias("item_id"),
            F.col(item_text).cast("string").alias("item_text"),
        ),
        "benchmark-items",
    )
    seeds = staged(
        items.select("item_row", "item_text").mapInArrow(_seed_rows(least), "item_row bigint, seed bigint")
        .groupBy("item_row", "seed").agg(F.count("*").alias("places")),
        "benchmark-seeds",
    )
    bitmap = spark.sparkContext.broadcast(seed_bitmap(seeds))
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), *keys, F.col(text).cast("string").alias("text")
    )
    kinds = [field.dataType.simpleString() for field in source.schema.fields]
    schema = ", ".join([*(f"c{i} {kind}" for i, kind in enumerate(kinds)), "seeds array<bigint>"])
    names = ["row", *(f"k{i}" for i in range(len(keys))), "text", "seeds"]
    found = staged(source.mapInArrow(_candidates(bitmap, BITMAP_BITS, least), schema).toDF(*names), "leak-candidates")
    lengths = seeds.groupBy("item_row").agg((F.sum("places") + least - 1).alias("most"))
    pairs = (
        found.select("row", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("row", "item_row")
        .agg(F.sum("places").alias("shared"))
        .join(lengths, "item_row")
        .where(F.col("shared") * least >= F.col("most") * coverage)
    )
    texts = pairs.select("row", "item_row").join(items, "item_row").join(found.drop("seeds"), "row")
    key_names = [f"k{i}" for i in range(len(keys))]
    tiled = texts.select(*key_names, "item_id", "text", "item_text")
    kinds = [field.dataType.simpleString() for field in tiled.schema.fields[:-2]]
    schema = ", ".join(
        [*(f"c{i} {kind}" for i, kind in enumerate(kinds)),
         "n_tokens bigint, n_covered bigint, n_tiles bigint, longest_tile bigint"]
    )
    return (
        tiled.mapInArrow(_tiled(least), schema)
        .toDF(*keys, item, "n_tokens", "n_covered", "n_tiles", "longest_tile")
        .withColumn("coverage", F.col("n_covered") / F.col("n_tokens"))
        .where(F.col("coverage") >= coverage)
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents whose text is in no pair, with their columns; others stay whole."""
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), digest.alias("digest"))
    leaked = staged(leaks(named, benchmark, ["digest"], **options).select("digest").distinct(), "leaked-texts")
    return named.join(leaked, "digest", "left_anti").select("row.*")
