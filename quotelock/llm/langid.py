"""Language identification by a linear-chain conditional random field over words.

Every word gets weights of its affixes, of its byte n-grams and, when the lexicon has it,
of itself; transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's language probabilities, so switches inside a text are
seen, and a text's language is the one with the largest share.

The field is fitted to a bounded sample of labelled texts. Runs of their lines are spliced
into sequences that switch between two texts, for the transitions. One task fits it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelock.llm.buffers import Words, buffer, find_words, mixed, per_text, slices
from quotelock.llm.crf import CHUNK, batch_gradient, posteriors

UNKNOWN = "und"
#: Bound of the labelled sample, in documents.
SAMPLE_DOCS = 2000
BUCKETS = 1 << 16
LEXICON_COUNT = 3
LEXICON_WORDS = 1 << 15
BATCH = 256
EPOCHS = 4
RATE = 0.3
DECAY = 1e-6
AFFIXES = (1, 2, 3)
GRAMS = (2, 3)

#: Only ASCII letters and bytes beyond ASCII are part of words.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20
_MARK = 0x01
_LETTER = regex.compile(r"\p{L}")


def letter_words(column: pa.Array) -> Words:
    data, offsets = buffer(pc.utf8_lower(column.cast(pa.large_string())))
    return find_words(data, offsets, LETTERS)


@dataclass(frozen=True)
class Features:
    """Buckets of words: ``buckets[bounds[i] : bounds[i + 1]]`` are those of word ``i``."""

    buckets: np.ndarray
    bounds: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.buckets], self.bounds[:-1], axis=0)

    def gradient(self, of_words: np.ndarray) -> np.ndarray:
        spread = np.repeat(of_words, np.diff(self.bounds), axis=0)
        return np.stack(
            [np.bincount(self.buckets, weights=spread[:, k], minlength=BUCKETS) for k in range(spread.shape[1])], axis=1
        )


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> Features:
    """Affix, n-gram and lexicon features of the given words (each has at least its n-grams)."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked = np.full(int(bounds[-1]), _MARK, np.uint64)
    inside = np.arange(int(lengths.sum())) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)
    marked[inside] = data[np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]
    word = np.repeat(np.arange(len(lengths)), lengths + 2)
    place = np.arange(len(marked)) - bounds[word]
    found, owners = [], []

    def add(kind: int, values: np.ndarray, owner: np.ndarray) -> None:
        found.append((mixed(values, kind + 1) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner)

    value = np.zeros(len(marked), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        grown = (value[: len(marked) - size + 1] << np.uint64(8)) | marked[size - 1 :] if size > 1 else marked
        value = grown
        at = np.flatnonzero(place[: len(value)] + size <= lengths[word[: len(value)]] + 2)
        if size in GRAMS:
            add(size, value[at], word[at])
    for size in AFFIXES:
        long = np.flatnonzero(lengths >= size)
        for side, first in ((10, starts[long]), (20, ends[long] - size)):
            affix = np.zeros(len(long), np.uint64)
            for step in range(size):
                affix = (affix << np.uint64(8)) | data[first + step]
            add(side + size, affix, long)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == hashes)
        add(30, hashes[known], known)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Features(np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(lengths) + 1)))


@dataclass(frozen=True)
class Field:
    """A fitted field: labels, weights of buckets, of first labels and of transitions."""

    labels: tuple[str, ...]
    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray
    lexicon: np.ndarray


def _training_sequences(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places and bounds of sequences: texts in runs, two texts taking turns in half of them."""
    random = np.random.default_rng(7)
    order = random.permutation(np.flatnonzero(words.counts > 0))
    runs, bounds = [], [0]

    def runs_of(text: int) -> list[np.ndarray]:
        places = np.arange(words.first[text], words.first[text + 1])
        return np.split(places, range(CHUNK // 4, len(places), CHUNK // 4))

    for one, two in zip(order[0::2], order[1::2], strict=False):
        a, b = runs_of(one), runs_of(two)
        half = min(len(a), len(b)) // 2
        mixed_runs = [run for pair in zip(a[:half], b[:half], strict=True) for run in pair]
        for part in (mixed_runs, a[half:], b[half:]):
            for start in range(0, len(part), 4):
                sequence = np.concatenate(part[start : start + 4])
                runs.append(sequence)
                bounds.append(bounds[-1] + len(sequence))
    return np.concatenate(runs) if runs else np.empty(0, np.int64), np.array(bounds)


def fit_field(texts: pa.Array, langs: list[str], labels: tuple[str, ...]) -> Field:
    """Fit a field to labelled texts by AdaGrad on batches of sequences."""
    words = letter_words(texts)
    hashes = words.hashes()
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, minlength=len(unique))
    frequent = np.lexsort((unique, -counts))[:LEXICON_WORDS]
    lexicon = np.sort(unique[frequent[counts[frequent] >= LEXICON_COUNT]])
    number = {label: k for k, label in enumerate(labels)}
    of_word = np.repeat([number[lang] for lang in langs], words.counts)
    places, bounds = _training_sequences(words, of_word)
    size = len(labels)
    weights, first_weights, steps = np.zeros((BUCKETS, size)), np.zeros(size), np.zeros((size, size))
    squares = [np.full_like(array, 1e-2) for array in (weights, first_weights, steps)]
    random = np.random.default_rng(11)
    for _ in range(EPOCHS):
        order = random.permutation(len(bounds) - 1)
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            at = np.concatenate([places[bounds[i] : bounds[i + 1]] for i in chosen])
            cuts = np.concatenate([[0], np.cumsum([bounds[i + 1] - bounds[i] for i in chosen])])
            known, back = np.unique(inverse[at], return_inverse=True)
            found = features(words.data, words.starts[first[known]], words.ends[first[known]], unique[known], lexicon)
            field = Field(labels, weights, first_weights, steps, lexicon)
            emission = found.scores(weights)[back]
            by_word, by_first, by_step = batch_gradient(emission, of_word[at], cuts, field)
            summed = np.stack([np.bincount(back, weights=by_word[:, k], minlength=len(known)) for k in range(size)], axis=1)
            for array, square, gradient in zip(
                (weights, first_weights, steps), squares, (found.gradient(summed), by_first, by_step), strict=True
            ):
                gradient = gradient / len(chosen) - DECAY * array
                square += gradient**2
                array += RATE * gradient / np.sqrt(square)
    return Field(labels, weights.astype(np.float32), first_weights, steps, lexicon)


def _fit_sample(labels: tuple[str, ...]):
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("lang", "ascending"), ("text", "ascending")]).combine_chunks()
        field = fit_field(sample.column("text").combine_chunks(), sample.column("lang").to_pylist(), labels)
        arrays = (field.weights, field.first, field.steps, field.lexicon)
        kinds = (np.float32, np.float64, np.float64, np.uint64)
        values = [pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds, strict=True)]
        return pa.table(values, names=["weights", "first", "steps", "lexicon"])

    return run


def learn(labelled: DataFrame, key: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Field | None:
    """Fit to at most ``sample`` labelled texts: of every language those with the least hashes of their keys.

    Languages are counted over all labelled texts, so a rare one is learned like any other;
    each gives at most an equal share of the sample, and at least one text. One task fits
    the sample, whatever the number of partitions, and one field reaches the driver: its
    size follows the number of languages alone. Repeated rows may count more than once.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(F.col(key), F.lit(17)).alias("order"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")
    )
    labels = tuple(sorted(row["lang"] for row in rows.groupBy("lang").count().collect()))
    if not labels:
        return None
    share = max(1, sample // len(labels))
    ranked = Window.partitionBy("lang").orderBy("order")
    cuts = (
        rows.select("lang", "order")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= share)
        .groupBy("lang")
        .agg(F.max("order").alias("cut"))
    )
    # One row for each of ``labels``.
    fitted = (
        rows.join(F.broadcast(cuts), "lang")
        .where("order <= cut")
        .select("text", "lang")
        .groupBy()
        .applyInArrow(_fit_sample(labels), "weights binary, first binary, steps binary, lexicon binary")
        .first()
    )
    size = len(labels)
    read = lambda name, kind: np.frombuffer(fitted[name], kind)
    return Field(
        labels,
        read("weights", np.float32).reshape(-1, size),
        read("first", np.float64),
        read("steps", np.float64).reshape(size, size),
        read("lexicon", np.uint64),
    )


def _label_texts(column: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Summed label probabilities and number of label switches of each text."""
    words = letter_words(column)
    if not len(words.starts):
        return np.zeros((len(column), len(field.labels))), np.zeros(len(column), np.int64)
    unique, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    found = features(words.data, words.starts[first], words.ends[first], unique, field.lexicon)
    node = posteriors(found.scores(field.weights).astype(float)[inverse], words.first, field)
    best = node.argmax(axis=1)
    switched = np.zeros(len(best), np.int64)
    switched[1:] = best[1:] != best[:-1]
    switched[words.first[:-1][words.counts > 0]] = 0
    totals = np.stack([per_text(node[:, k], words.first) for k in range(len(field.labels))], axis=1)
    return totals, per_text(switched, words.first)


def identify(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``lang_pred``, ``score`` (share of the text), ``n_switches``.

    NULL texts and texts without a letter are ``und`` with score 0, and so is every text
    without a fitted field. Letters of scripts that no feature knows still get the labels
    that transitions and first labels favour. Each row stands for itself, and whole texts
    are read, however long. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                texts = part.column(1)
                lettered = np.array([bool(value and _LETTER.search(value)) for value in texts.to_pylist()], bool)
                names, scores, switches = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if fitted is not None:
                    totals, switches = _label_texts(texts, fitted)
                    whole = totals.sum(axis=1)
                    told = lettered & (whole > 0)
                    best = totals.argmax(axis=1)
                    names[told] = np.array(fitted.labels, object)[best[told]]
                    scores[told] = np.minimum(1.0, totals[told, best[told]] / whole[told])
                    switches = np.where(told, switches, 0)
                columns = [part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(switches)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "n_switches"])

    return source.mapInArrow(run, f"key {kind}, lang_pred string, score double, n_switches bigint").withColumnRenamed("key", key)
