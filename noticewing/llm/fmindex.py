"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix, searched backwards."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector of packed words with the ones before each, for rank queries on many places at once."""

    def __init__(self, bits: np.ndarray):
        n = (len(bits) >> 6) + 1
        padded = np.zeros(n << 6, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        inside = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Symbols by their bits from the highest, a bit vector per level; rank takes one query a level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        current = symbols
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (current >> shift) & 1
            one = bit.astype(bool)
            self.levels.append((shift, Bits(bit.astype(np.uint8)), int(len(bit) - one.sum())))
            current = np.concatenate((current[~one], current[one]))

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the symbol occurs before low and before high."""
        start = np.zeros_like(low)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            s, a, b = bits.rank(start), bits.rank(low), bits.rank(high)
            start = np.where(one, zeros + s, start - s)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return low - start, high - start


class FmIndex:
    """Index of texts of symbols from 1 on, each of less than `most` symbols and ended by a 0.

    Suffixes are sorted by their first `most` symbols (prefix doubling), more than any text has.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, most: int):
        n = len(text)
        rank = np.append(text.astype(np.int64), np.zeros(0, np.int64))
        self.text = text
        self.by_length = {1: rank}
        length, order = 1, np.argsort(rank, kind="stable")
        while length < most:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: max(n - length, 0)] = rank[length:] + 1
            key = rank * np.int64(n + n_symbols + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.ones(n, dtype=bool)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            length *= 2
            self.by_length[length] = rank
        self.order = order
        self.last = WaveletMatrix(text[order - 1], n_symbols + 1)
        self.first = np.searchsorted(np.sort(text), np.arange(n_symbols + 2))

    def groups(self, length: int) -> np.ndarray:
        """For each place in suffix order, the number of its group of suffixes equal in their first `length` symbols."""
        same = np.ones(max(len(self.order) - 1, 0), dtype=bool)
        at, part = 0, 1 << length.bit_length()
        while at < length:
            part >>= 1
            if at + part <= length:
                ranks = self.by_length[part]
                place = np.minimum(self.order + at, len(ranks) - 1)
                same &= ranks[place][1:] == ranks[place][:-1]
                at += part
        return np.concatenate(([0], np.cumsum(~same)))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol before them; empty ones have low == high."""
        a, b = self.last.ranks(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


def matched(index: FmIndex, patterns: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Backward search of many patterns side by side, from their last symbol.

    Yields (patterns still matching, place in them, matched length, interval) after every symbol: the
    matching statistics of the pattern's end. A pattern without a match drops out.
    """
    live = np.flatnonzero(size > 0)
    low = np.zeros(len(live), dtype=np.int64)
    high = np.full(len(live), len(index.text), dtype=np.int64)
    depth = 0
    while len(live):
        place = size[live] - 1 - depth
        low, high = index.extend(patterns[first[live] + place], low, high)
        depth += 1
        found = low < high
        live, place, low, high = live[found], place[found], low[found], high[found]
        yield live, place, depth, low, high
        more = place > 0
        live, low, high = live[more], low[more], high[more]
