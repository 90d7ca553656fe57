"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled bad or good. Its features are measures of the line, each
cut to a few bins, and the same measures of the line before and the line after it;
transitions between the labels of neighbouring lines are learned with them. Forward-backward
gives the probability that a line is good, and a document's score is the mean of these,
weighted by the lines' lengths.

Only documents are labelled, so in training each line has the label of its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import buffer, find_words, mixed, per_text, slices
from quotelock.llm.crf import batch_gradient, posteriors

#: Bound of the labelled sample, in documents.
SAMPLE_DOCS = 4000
#: Passes over the sample; a small sample takes more, to the same least number of steps.
EPOCHS = 12
STEPS = 150
BATCH = 64
RATE = 0.2
DECAY = 1e-5
#: Training sequences have at most so many lines; longer texts give several.
SEQUENCE = 64
#: Score of every document without a fitted field.
UNFITTED = 0.5

BINS = 12
#: Upper edges of the bins of measures that are shares.
_SHARES = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])

_LETTER, _DIGIT, _UPPER, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_LETTER[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = True
_DIGIT[[c for c in range(128) if chr(c).isdigit()]] = True
_UPPER[[c for c in range(128) if chr(c).isupper()]] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SYMBOL &= ~_MARK
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\"'"]] = True


@dataclass(frozen=True)
class Lines:
    """Lines with a word of several texts: bin features, lengths, and the lines' range of each text."""

    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of ``part / whole``; wholes are counts."""
    return np.searchsorted(_SHARES, part / np.maximum(whole, 1), side="left")


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts + 1.0)), BINS - 1).astype(np.int64)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Places whose key has been at an earlier place."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    return again


def lines_of(column: pa.Array) -> Lines:
    """Lines and their features; a text without a word has none."""
    data, offsets = buffer(column)
    words = find_words(data, offsets)
    n_words = len(words.starts)
    if not n_words:
        return Lines(np.empty((0, 0), np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    breaks = np.union1d(np.flatnonzero(data == 0x0A), offsets[1:-1])
    line_of_word = np.searchsorted(breaks, words.starts, side="right")
    new = np.ones(n_words, bool)
    new[1:] = line_of_word[1:] != line_of_word[:-1]
    head = np.flatnonzero(new)
    bounds = np.append(head, n_words)
    starts, ends = words.starts[head], words.ends[bounds[1:] - 1]
    line = np.cumsum(new) - 1
    text = words.owner()[head]

    def inside(table: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(table[data])])
        return running[ends] - running[starts]

    def words_where(mask: np.ndarray) -> np.ndarray:
        return per_text(mask.astype(np.int64), bounds)

    hashes = words.hashes()
    sizes = words.ends - words.starts
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    odd = letters[words.ends] == letters[words.starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    marked = (symbols[words.ends] > symbols[words.starts]) & ~odd
    twice = np.zeros(n_words, bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    in_line = _repeats(mixed(hashes ^ mixed(line.astype(np.uint64), 5)))
    place = (np.arange(n_words) - np.repeat(head, np.diff(bounds))).astype(np.uint64)
    whole_line = per_text(mixed(hashes + place * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), bounds).view(np.uint64)
    repeated_line = _repeats(mixed(whole_line ^ mixed(text.astype(np.uint64), 9)))
    count, bytes_in = np.diff(bounds), ends - starts
    chars = inside((np.arange(256) & 0xC0) != 0x80)
    first = np.searchsorted(text, np.arange(len(offsets)))
    of_text = np.diff(first)[text]
    rank = np.arange(len(head)) - first[text]
    measures = [
        _logs(count),
        np.minimum(per_text(sizes, bounds) // np.maximum(count, 1), BINS - 1),
        _share(inside(_SYMBOL), bytes_in),
        _share(inside(_DIGIT), bytes_in),
        _share(inside(_UPPER), bytes_in),
        _share(inside(_MARK), bytes_in),
        _share(words_where(odd), count),
        _share(words_where(marked), count),
        _share(words_where(twice), count),
        _share(words_where(in_line), count),
        _share(words_where(sizes <= 3), count),
        _share(bytes_in - chars, bytes_in),
        repeated_line.astype(np.int64),
        _ENDS[data[ends - 1]].astype(np.int64) + 2 * _UPPER[data[starts]],
        _logs(of_text),
        np.where(rank == 0, 1, 0) + np.where(rank == of_text - 1, 2, 0),
    ]
    own = np.stack(measures, axis=1)
    kinds = own.shape[1]
    away = np.full_like(own, BINS)
    before, after = away.copy(), away.copy()
    before[1:] = np.where((text[1:] == text[:-1])[:, None], own[:-1], BINS)
    after[:-1] = np.where((text[1:] == text[:-1])[:, None], own[1:], BINS)
    wide = np.concatenate([own, before, after], axis=1) + (BINS + 1) * np.arange(3 * kinds)
    return Lines(wide, chars, first)


@dataclass(frozen=True)
class QualityField:
    """A fitted field: weights of features by label (bad, good), of first labels and transitions."""

    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray
    #: Share of good documents in the sample, the score of texts without a word.
    prior: float

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)


def fit_lines(texts: pa.Array, good: np.ndarray) -> QualityField:
    """Fit a field to texts and the labels (0 or 1) of their documents, by AdaGrad on batches of sequences."""
    lines = lines_of(texts)
    prior = (float(good.sum()) + 1) / (len(good) + 2)
    size = (BINS + 1) * lines.features.shape[1]
    weights, first, steps = np.zeros((size, 2)), np.zeros(2), np.zeros((2, 2))
    squares = [np.full_like(array, 1e-2) for array in (weights, first, steps)]
    labels = np.repeat(good.astype(np.int64), np.diff(lines.first))
    edges = [np.arange(a, b, SEQUENCE) for a, b in zip(lines.first[:-1], lines.first[1:])]
    starts = np.concatenate(edges) if edges else np.empty(0, np.int64)
    stops = np.append(starts[1:], len(labels))
    random = np.random.default_rng(11)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(starts))))
    for _ in range(epochs if len(starts) else 0):
        order = random.permutation(len(starts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            places = np.concatenate([np.arange(starts[i], stops[i]) for i in chosen])
            bounds = np.concatenate([[0], np.cumsum(stops[chosen] - starts[chosen])])
            found = lines.features[places]
            by_line, by_first, by_step = batch_gradient(
                weights[found].sum(axis=1), labels[places], bounds, QualityField(weights, first, steps, prior)
            )
            by_feature = np.stack(
                [np.bincount(found.ravel(), np.repeat(by_line[:, k], found.shape[1]), size) for k in range(2)], axis=1
            )
            for array, square, gradient in zip((weights, first, steps), squares, (by_feature, by_first, by_step), strict=True):
                gradient = gradient / len(chosen) - DECAY * array
                square += gradient**2
                array += RATE * gradient / np.sqrt(square)
    return QualityField(weights, first, steps, prior)


def score_texts(column: pa.Array, field: QualityField) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: mean probability of a good line by length, lines, and lines more likely bad."""
    lines = lines_of(column)
    counts = np.diff(lines.first)
    scores, bad = np.full(len(column), field.prior), np.zeros(len(column), np.int64)
    if len(lines.lengths):
        good = posteriors(field.emission(lines.features), lines.first, field)[:, 1]
        bad = per_text((good < 0.5).astype(np.int64), lines.first)
        summed = per_text(good * lines.lengths, lines.first)
        full = counts > 0
        scores[full] = np.clip(summed[full] / per_text(lines.lengths, lines.first)[full], 0.0, 1.0)
    return scores, counts, bad


def _fit_sample(sample: pa.Table) -> pa.Table:
    sample = sample.sort_by([("good", "ascending"), ("text", "ascending")]).combine_chunks()
    field = fit_lines(sample.column("text").combine_chunks(), sample.column("good").to_numpy())
    arrays = (field.weights, field.first, field.steps, np.array([field.prior]))
    values = [pa.array([np.ascontiguousarray(array, np.float64).tobytes()], pa.binary()) for array in arrays]
    return pa.table(values, names=["weights", "first", "steps", "prior"])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE_DOCS,
) -> QualityField | None:
    """Fit to the documents of at most ``sample`` labelled keys, those with the least hashes.

    A key that several label rows name counts once, with its greatest label; of several
    texts of one key the least counts. Labels other than 0 and 1, NULL keys and keys
    without a document are left out; a NULL text is empty. One task fits the sample,
    whatever the number of partitions. Without a labelled document the result is None.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("bigint").alias("good"))
        .orderBy(F.xxhash64("key", F.lit(23)), "key")
        .limit(sample)
    )
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    fitted = (
        texts.join(chosen, "key")
        .groupBy("key", "good")
        .agg(F.min("text").alias("text"))
        .select("text", "good")
        .groupBy()
        .applyInArrow(_fit_sample, "weights binary, first binary, steps binary, prior binary")
        .first()
    )
    if fitted is None:
        return None
    read = lambda name: np.frombuffer(fitted[name], np.float64)
    return QualityField(read("weights").reshape(-1, 2), read("first"), read("steps").reshape(2, 2), float(read("prior")[0]))


def judge(docs: DataFrame, field: QualityField | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``score`` (0 to 1, higher for good), ``n_lines`` with a word, ``n_bad_lines``.

    Texts that are NULL, empty or without a word score the share of good documents in the
    sample, and every text 0.5 without a fitted field. Each row stands for itself, and whole
    texts are read, however long. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                if fitted is None:
                    lines = lines_of(part.column(1))
                    found = np.full(part.num_rows, UNFITTED), np.diff(lines.first), np.zeros(part.num_rows, np.int64)
                else:
                    found = score_texts(part.column(1), fitted)
                columns = [part.column(0), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "score", "n_lines", "n_bad_lines"])

    return source.mapInArrow(run, f"key {kind}, score double, n_lines bigint, n_bad_lines bigint").withColumnRenamed("key", key)
