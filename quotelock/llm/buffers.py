"""Whole columns of text as byte buffers: words and word windows without an object per word.

A slice of an Arrow column is one run of bytes with offsets. Words, their 64-bit
hashes and the hashes of word windows are found for the whole slice at once. Hashes
depend on the bytes alone, so they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
HASH_BLOCK = 1 << 20
LONG_WORD = 4096

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII characters that are neither letters nor digits count as white space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly; another ``seed`` gives an independent order."""
    x = values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, length: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < length:
        steps = np.full(max(length, HASH_BLOCK) + 1, base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known


def _block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word of a block, from one running sum over its bytes."""
    first = int(starts[0])
    part = data[first : int(ends[-1])].astype(np.uint64)
    part += np.uint64(1)
    part *= _power("up", _BASE, len(part))[: len(part)]
    running = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part, out=running[1:])
    inside = running[ends - first] - running[starts - first]
    return mixed(inside * _power("down", _INVERSE, len(part))[starts - first])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; memory is bounded by blocks of words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    for long in [*np.flatnonzero(ends - starts > LONG_WORD), len(starts)]:
        while at < long:
            stop = int(min(long, max(at + 1, np.searchsorted(ends, starts[at] + HASH_BLOCK, "right"))))
            out[at:stop] = _block_hashes(data, starts[at:stop], ends[at:stop])
            at = stop
        if at < len(starts):
            out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]].tobytes())
            at += 1
    return out


@dataclass
class Words:
    """Words of several texts: byte ranges, and the words' range of each text."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``width`` words inside one text."""
        ends = np.repeat(self.first[1:], self.counts)
        starts = np.flatnonzero(np.arange(len(hashes)) + width <= ends)
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        value = np.zeros(len(hashes) - width + 1, np.uint64)
        for step in range(width):
            value *= _STEP
            value += hashes[step : len(hashes) - width + 1 + step]
        return starts, mixed(value[starts])


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> Words:
    """Runs of bytes other than ASCII white space, cut at the ends of texts."""
    if table is not None:
        data = table[data]
    inside = ~WHITE[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        opens[1:] &= ~inside[:-1] | cut[1:-1]
        closes[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(opens)
    return Words(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most:
            yield start, row
            start, total = row, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and their n + 1 offsets; NULL counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between consecutive bounds."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], dtype=out.dtype)
    return out


class Roller:
    """Karp-Rabin hashes of all windows of one token sequence, at any length."""

    def __init__(self, values: np.ndarray) -> None:
        powers = np.full(len(values) + 1, _STEP, np.uint64)
        powers[0] = 1
        downs = np.full(len(values) + 1, _STEP_INVERSE, np.uint64)
        downs[0] = 1
        self.down = np.multiply.accumulate(downs)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * np.multiply.accumulate(powers)[:-1], out=self.sums[1:])

    def windows(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.down[starts]
