"""A compressed FM-index over sequences of words: a wavelet matrix over the BWT."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with counts per 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        cell = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[cell] + np.bitwise_count(self.words[cell] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append(BitVector(ones))
            self.zeros.append(len(symbols) - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before its position."""
        first, last = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (vector, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            ones = vector.rank(np.concatenate([first, last]))
            first = np.where(one, zeros + ones[: len(at)], first - ones[: len(at)])
            last = np.where(one, zeros + ones[len(at) :], last - ones[len(at) :])
        return last - first


def suffix_order(ranks: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of ``ranks`` by prefix doubling.

    Separators have ranks of their own, so no comparison is longer than ``longest``.
    """
    step, size = 1, len(ranks)
    order = np.argsort(ranks, kind="stable")
    while step <= longest:
        following = np.zeros(size, np.int64)
        following[:-step] = ranks[step:] + 1 if step < size else 0
        keys = ranks * (size + 2) + following
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        ranks = np.empty(size, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if ranks[order[-1]] == size - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Index of several sequences of word numbers; words met once share a symbol.

    ``find`` searches backwards. A pattern that holds a word met once, or whose interval
    has come down to one place, is met once itself and is not searched further.
    """

    def __init__(self, sequences: np.ndarray, bounds: np.ndarray) -> None:
        count = len(bounds) - 1
        lengths = np.diff(bounds)
        self.bounds = bounds
        met = np.bincount(sequences, minlength=int(sequences.max(initial=0)) + 1)
        number = np.zeros(len(met), np.int64)
        number[met > 1] = np.arange(1, np.count_nonzero(met > 1) + 1)
        self.symbols = number[sequences]
        self.places = np.arange(len(sequences)) + np.repeat(np.arange(count), lengths)
        total = len(sequences) + count
        text = np.zeros(total, np.int64)
        text[self.places] = self.symbols
        single = np.zeros(total, bool)
        single[self.places] = self.symbols == 0
        ends = bounds[1:] + np.arange(count)
        ranks = text + count + np.count_nonzero(single) - 1
        ranks[ends] = np.arange(count)
        ranks[single] = count + np.arange(np.count_nonzero(single))
        self.order = suffix_order(ranks, int(lengths.max(initial=1)) + 1)
        last = text[self.order - 1]
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        self.wavelet = WaveletMatrix(last, self.bits)
        self.starts = np.searchsorted(text[self.order], np.arange(int(text.max(initial=0)) + 2))
        self.owner = np.full(total, count - 1 if count else 0)
        self.owner[self.places] = np.repeat(np.arange(count), lengths)
        self.owner[ends] = np.arange(count)

    def find(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns ``symbols[start : start + length]`` of the indexed words.

        Patterns met once get an empty interval.
        """
        last = self.symbols[starts + length - 1]
        low, high = self.starts[last], self.starts[last + 1]
        going = np.flatnonzero((last > 0) & (high - low > 1))
        low_out, high_out = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        low, high = low[going], high[going]
        for step in range(length - 2, -1, -1):
            symbol = self.symbols[starts[going] + step]
            ranks = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.starts[symbol] + ranks[: len(going)], self.starts[symbol] + ranks[len(going) :]
            on = (symbol > 0) & (high - low > 1)
            going, low, high = going[on], low[on], high[on]
        low_out[going], high_out[going] = low, high
        return low_out, high_out

    def least(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Least value, by sequence, in each interval; equal patterns are looked at once."""
        out = np.full(len(low), np.iinfo(np.int64).max)
        full = np.flatnonzero(high > low)
        if not len(full):
            return out
        lows, first, inverse = np.unique(low[full], return_index=True, return_inverse=True)
        highs = high[full][first]
        ordered = np.append(values[self.owner[self.order]], np.iinfo(np.int64).max)
        cuts = np.stack([lows, highs], axis=1).ravel()
        out[full] = np.minimum.reduceat(ordered, cuts)[::2][inverse]
        return out
