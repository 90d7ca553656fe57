"""Scoring texts by prediction by partial matching over bytes.

The model is a trie of byte contexts with counts. A byte is coded in its longest known
context; when the context has not seen it, an escape leads to the next shorter one, where
the symbols of the longer context are excluded. Escapes are estimated by the number of
distinct symbols. The last context excludes them too and gives every byte left an equal share.

Counts come from all training texts, and the trie has every node that was counted: it is
a table, and so are its contexts. A gram's code length depends on the gram alone, so it is
worked out once per distinct gram by equi joins with the two. Those of the most frequent
grams are sent to every task as a cache; the others meet the texts' grams by an equi join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import buffer, mixed, per_text, slices
from quotelock.llm.staging import staged

DEPTH = 4
#: Nodes with a smaller share of all counted bytes are left out; by default none is.
SHARE = 0.0
#: A gram is in the cache when its share of all counted bytes is at least this, so at most
#: ``1 / CACHED`` are.
CACHED = 2.0**-22
#: Nodes of at most this order are sent to every task: there are at most ``SYMBOLS**2``.
SHORT = 1
#: A word is common when its share of training tokens is at least this, so at most
#: ``1 / COMMON`` words are.
COMMON = 2.0**-16
EDGE = 0xFF
#: Bytes of lower-cased UTF-8 (13 bytes never occur, 26 are capitals) and the end.
SYMBOLS = 256 - 13 - 26 + 1
MOST_WORDS = 1 << 18
CACHE_BITS = 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LOWER_BYTES = LOWER.tobytes()


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it as one number, and the texts' ranges.

    The byte 0xFF, which UTF-8 does not use, stands before each text and once after it, so
    a text's length is part of what is predicted.
    """
    count = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(data) + count * (depth + 1), EDGE, np.uint8)
    first = offsets[:-1] + np.arange(count) * (depth + 1) + depth
    at = np.arange(len(data)) + np.repeat(np.arange(count) * (depth + 1) + depth, lengths)
    padded[at] = LOWER[data]
    keys = np.zeros(len(padded), np.int64)
    for back in range(depth, -1, -1):
        keys <<= 8
        keys[back:] |= padded[: len(padded) - back] if back else padded
    coded = np.zeros(len(padded), bool)
    coded[at] = True
    coded[first + lengths] = True
    bounds = offsets + np.arange(count + 1)
    return keys[coded], bounds


def lower_words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER_BYTES).split()


@dataclass(frozen=True)
class ByteModel:
    """The trie as arrays: per depth, the nodes' byte strings as sorted numbers, and counts."""

    depth: int
    nodes: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]

    @classmethod
    def build(cls, grams: np.ndarray, counts: np.ndarray, least: float, depth: int = DEPTH) -> ByteModel:
        """From counts of full grams; a shorter node's count is the sum over what is before it."""
        nodes, sums = [], []
        for length in range(1, depth + 2):
            keys, inverse = np.unique(grams & ((1 << (8 * length)) - 1), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(keys))
            kept = total >= least
            nodes.append(keys[kept])
            sums.append(total[kept])
        return cls(depth, tuple(nodes), tuple(sums))


class Level(NamedTuple):
    """What the trie has of some grams at one order, one entry per gram."""

    known: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    covered: np.ndarray
    count: np.ndarray


def code_lengths(levels: Iterable[Level], grams: int) -> np.ndarray:
    """log10 of the probability of each gram's last byte, from its levels, the longest first.

    Every symbol of a context is a symbol of the next shorter one, because its count
    there is no smaller; so what is excluded is what the longer context has.
    """
    out, taken, seen = np.zeros(grams), np.zeros(grams), np.zeros(grams)
    done = np.zeros(grams, bool)
    for level in levels:
        total = np.where(level.known, level.total - taken, 0.0)
        distinct = np.where(level.known, level.distinct - seen, 0.0)
        open_here = ~done & level.known & (distinct > 0)
        hit = open_here & (level.count > 0)
        whole = np.where(open_here, total + distinct, 1.0)
        out += np.log10(np.where(hit, level.count, np.where(open_here, distinct, 1.0)) / whole)
        taken = np.where(level.known, level.covered, 0.0)
        seen = np.where(level.known, level.distinct, 0.0)
        done |= hit
    out[~done] -= np.log10(np.maximum(SYMBOLS - seen[~done], 1.0))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class ByteScorer:
    """Code lengths of grams under a model in memory, vectorised."""

    def __init__(self, model: ByteModel) -> None:
        self.model = model
        self.contexts: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.distinct: list[np.ndarray] = []
        self.covered: list[np.ndarray] = []
        for order in range(model.depth + 1):
            keys, counts = model.nodes[order], model.counts[order]
            contexts, inverse = np.unique(keys >> 8, return_inverse=True)
            self.contexts.append(contexts)
            self.total.append(np.bincount(inverse, weights=counts, minlength=len(contexts)))
            self.distinct.append(np.bincount(inverse, minlength=len(contexts)).astype(float))
            shorter = self._count(order - 1, keys & ((1 << (8 * order)) - 1)) if order else np.zeros(len(keys))
            self.covered.append(np.bincount(inverse, weights=shorter, minlength=len(contexts)))

    def _count(self, order: int, keys: np.ndarray) -> np.ndarray:
        at = _find(self.model.nodes[order], keys)
        if not len(self.model.counts[order]):
            return np.zeros(len(keys))
        return np.where(at >= 0, self.model.counts[order][at], 0.0)

    def level(self, order: int, keys: np.ndarray) -> Level:
        part = keys & ((1 << (8 * (order + 1))) - 1)
        at = _find(self.contexts[order], part >> 8)
        if not len(self.contexts[order]):
            return Level(at >= 0, *[np.zeros(len(keys))] * 4)
        stats = (values[order][at] for values in (self.total, self.distinct, self.covered))
        return Level(at >= 0, *stats, self._count(order, part))

    def levels(self, keys: np.ndarray) -> list[Level]:
        return [self.level(order, keys) for order in range(self.model.depth, -1, -1)]

    def score(self, keys: np.ndarray) -> np.ndarray:
        return code_lengths(self.levels(keys), len(keys))


class Cache:
    """Code lengths of some grams, found by a slot of their own or else by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.slots = np.full(1 << CACHE_BITS, -1, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code lengths, 0 where there is none, and the places of those."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.arange(len(keys))
        at = self.slots[self._slot(keys)].astype(np.int64)
        other = np.flatnonzero((at < 0) | (self.keys[at] != keys))
        at[other] = _find(self.keys, keys[other])
        return np.where(at >= 0, self.values[at], 0.0), other[at[other] < 0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (with their end tokens) and of grams, combined per task."""
    words: Counter[bytes] = Counter()
    ends = 0

    def rows(keys: list[bytes], numbers: np.ndarray, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(numbers, pa.int64()), pa.array(counts, pa.int64())],
            names=["word", "gram", "n"],
        )

    def word_rows() -> Iterator[pa.RecordBatch]:
        found = list(words.items())
        words.clear()
        for start in range(0, len(found), 1 << 14):
            part = found[start : start + (1 << 14)]
            yield rows([word for word, _ in part], np.full(len(part), None), [count for _, count in part])

    held = np.empty(0, np.int64), np.empty(0, np.int64)

    def gram_rows() -> Iterator[pa.RecordBatch]:
        for start in range(0, len(held[0]), 1 << 15):
            part = slice(start, start + (1 << 15))
            yield rows([None] * len(held[0][part]), held[0][part], held[1][part])

    for batch in batches:
        for start, stop in slices(batch.column(0), 2 << 20):
            column = batch.column(0).slice(start, stop - start)
            keys = grams(*buffer(column))[0]
            fresh, counts = np.unique(keys, return_counts=True)
            merged, inverse = np.unique(np.concatenate([held[0], fresh]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([held[1], counts]), minlength=len(merged))
            held = merged, sums.astype(np.int64)
            for text in column.to_pylist():
                words.update(lower_words(text or ""))
                ends += 1
            if len(words) > MOST_WORDS:
                yield from word_rows()
            if len(held[0]) > 4 * MOST_WORDS:
                yield from gram_rows()
                held = np.empty(0, np.int64), np.empty(0, np.int64)
    yield from word_rows()
    yield from gram_rows()
    if ends:
        yield rows([b"\n"], np.full(1, None), [ends])


def training_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """``(word, gram, n)`` over all training texts; the end token is the word ``\\n``.

    Words are rows with a NULL gram and the other way round. NULL texts are empty.
    """
    counted = training.select(F.col(text).cast("string")).mapInArrow(
        _count_batches, "word binary, gram bigint, n bigint"
    )
    return counted.groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Trie(NamedTuple):
    """All nodes ``(order, node, n)``, and contexts ``(order, context, total, distinct, covered)``."""

    nodes: DataFrame
    contexts: DataFrame
    short: ByteModel


def byte_trie(counts: DataFrame, least: float = 0.0) -> Trie:
    """The trie of all nodes counted at least ``least`` times, as staged tables.

    Full grams under ``least`` still count for their shorter nodes. A context has at most
    :data:`SYMBOLS` nodes, and so has a node that others are longer than by one byte.
    """
    suffixes = [
        F.struct(F.lit(order).alias("order"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).alias("node"))
        for order in range(DEPTH + 1)
    ]
    nodes = staged(
        counts.where("gram is not null")
        .select(F.explode(F.array(*suffixes)).alias("at"), "n")
        .groupBy("at.order", "at.node")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least),
        "nodes",
    )
    shorter = nodes.select((F.col("order") + 1).alias("order"), F.col("node").alias("tail"), F.col("n").alias("shorter"))
    contexts = staged(
        nodes.withColumn("tail", F.expr("node & (shiftleft(1L, 8 * order) - 1)"))
        .join(shorter, ["order", "tail"], "left")
        .groupBy("order", F.shiftright("node", 8).alias("context"))
        .agg(
            F.sum("n").alias("total"),
            F.count("*").alias("distinct"),
            F.sum(F.coalesce("shorter", F.lit(0))).alias("covered"),
        ),
        "contexts",
    )
    few = nodes.where(F.col("order") <= SHORT).toArrow().sort_by([("order", "ascending"), ("node", "ascending")])
    orders, keys, sums = (few.column(name).to_numpy() for name in ("order", "node", "n"))
    of_order = [orders == order for order in range(SHORT + 1)]
    short = ByteModel(
        SHORT, tuple(keys[part] for part in of_order), tuple(sums[part].astype(float) for part in of_order)
    )
    return Trie(nodes, contexts, short)


def gram_lengths(wanted: DataFrame, trie: Trie) -> DataFrame:
    """``(gram, value)`` with the code length of each of the distinct grams ``(gram)``."""
    long = range(DEPTH, SHORT, -1)
    suffixes = [
        F.struct(F.lit(order).alias("order"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).alias("node"))
        for order in long
    ]
    met = (
        wanted.select("gram", F.explode(F.array(*suffixes)).alias("at"))
        .select("gram", "at.order", "at.node", F.shiftright("at.node", 8).alias("context"))
        .join(trie.nodes, ["order", "node"], "left")
        .join(trie.contexts, ["order", "context"], "left")
    )
    fields = ("total", "distinct", "covered", "n")
    flat = met.groupBy("gram").agg(
        *[F.max(F.when(F.col("order") == order, F.col(name))).alias(f"{name}{order}") for order in long for name in fields]
    )
    short = wanted.sparkSession.sparkContext.broadcast(trie.short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ByteScorer(short.value)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            levels = []
            for start in range(1, batch.num_columns, len(fields)):
                known = batch.column(start).is_valid().to_numpy(zero_copy_only=False)
                stats = [
                    pc.fill_null(batch.column(start + i), 0).to_numpy(zero_copy_only=False).astype(float)
                    for i in range(len(fields))
                ]
                levels.append(Level(known, *stats))
            values = code_lengths([*levels, *scorer.levels(keys)], len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["gram", "value"])

    return flat.mapInArrow(run, "gram bigint, value double")


_caches: dict[int, Cache] = {}


def _cache(lengths: tuple[np.ndarray, np.ndarray]) -> Cache:
    if id(lengths) not in _caches:
        _caches.clear()
        _caches[id(lengths)] = Cache(*lengths)
    return _caches[id(lengths)]


def _rare_lists(keys: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """Per row the distinct grams of it with their numbers."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    values = pa.StructArray.from_arrays([pa.array(keys[at]), pa.array(times.astype(np.int64))], ["gram", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[at], np.arange(rows + 1)).astype(np.int32)), values)


def _score_batches(shared, common_words):
    names = ["row", "key", "cached_score", "rare_grams", "n_tokens", "n_common", "common_score", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, common = _cache(shared.value), common_words.value
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                keys, bounds = grams(*buffer(part.column(2)))
                values, missed = cache.find(keys)
                scores = per_text(values, bounds)
                owner = np.searchsorted(bounds, missed, side="right") - 1
                rare_grams = _rare_lists(keys[missed], owner, part.num_rows)
                rows = []
                for text in part.column(2).to_pylist():
                    found = Counter(lower_words(text or ""))
                    found[b"\n"] += 1
                    number, known, value, rare = 0, 0, 0.0, []
                    for word, times in found.items():
                        number += times
                        gain = common.get(word)
                        if gain is None:
                            rare.append({"word": word, "times": times})
                        else:
                            known += times
                            value += times * gain
                    rows.append((number, known, value, rare))
                columns = [part.column(0), part.column(1), pa.array(scores), rare_grams]
                columns += [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), rare_type))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_texts(
    docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE
) -> DataFrame:
    """Per row of ``docs``: key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The base is an add-one unigram model over words and the end token. Counts of common
    words are sent to every task (there are at most ``1 / COMMON``); the others meet the
    documents' words by an equi join. NULL text counts as empty. Without training texts
    nothing is known and both scores use the least count. Repeated rows stay repeated.
    Nodes under ``share`` of all counted bytes are left out, by default none.
    """
    spark = docs.sparkSession
    counts = staged(training_counts(training, text), "training-counts")
    words = counts.where("word is not null").select("word", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = size["n"], size["v"]
    whole = np.log10(tokens + kinds + 1)
    common = {
        bytes(row["word"]): float(np.log10(row["n"] + 1) - whole)
        for row in words.where(F.col("n") >= max(1.0, COMMON * tokens)).collect()
    }
    full = counts.where("gram is not null").select("gram", "n")
    total = full.agg(F.sum("n")).first()[0] or 0
    trie = byte_trie(counts, share * total)
    frequent = gram_lengths(full.where(F.col("n") >= max(1.0, CACHED * total)).select("gram"), trie).toArrow()
    cached = spark.sparkContext.broadcast((frequent.column("gram").to_numpy(), frequent.column("value").to_numpy()))
    shared = spark.sparkContext.broadcast(common)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")
    )
    kind = source.schema["key"].dataType.simpleString()
    scored = staged(
        source.mapInArrow(
            _score_batches(cached, shared),
            f"row bigint, key {kind}, cached_score double, rare_grams array<struct<gram: bigint, times: bigint>>, "
            "n_tokens bigint, n_common bigint, common_score double, "
            "rare array<struct<word: binary, times: bigint>>",
        ),
        "scored",
    )
    rare = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.times")
    rare_words = words.where(F.col("n") < max(1.0, COMMON * tokens))
    known = (
        rare.join(rare_words, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_gain"))
    )
    rare_grams = scored.select("row", F.explode("rare_grams").alias("rare")).select("row", "rare.gram", "rare.times")
    lengths = staged(gram_lengths(rare_grams.select("gram").distinct(), trie), "gram-lengths")
    long = (
        rare_grams.join(lengths, "gram")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("value")).alias("rare_score"))
    )
    rare_known = F.coalesce("rare_known", F.lit(0))
    whole_rows = scored.drop("rare", "rare_grams").join(known, "row", "left").join(long, "row", "left")
    return whole_rows.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_common") + rare_known).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (
            F.col("common_score") + F.coalesce("rare_gain", F.lit(0.0)) - (F.col("n_tokens") - F.col("n_common")) * float(whole)
        ).alias("base_score"),
        (F.col("cached_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
