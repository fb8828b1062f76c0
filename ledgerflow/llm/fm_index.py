"""FM-index over a sequence of symbols, with numpy.

Symbol 0 separates runs: every 0 is a suffix end of its own (they sort by position), so
no match and no step of the locate walk crosses one. The Burrows-Wheeler transform is held in a
wavelet matrix of packed bits; suffix positions are kept where they are a multiple of
``rate`` and at the first symbol of every run.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    first = text.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    starts = np.concatenate([[True], sorted_first[1:] != sorted_first[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step = 1
    while True:
        sizes = np.diff(np.concatenate([np.flatnonzero(starts), [n]]))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order
        if not len(tied):
            return order
        own = order[tied]
        key = rank[own] * n + rank[np.minimum(own + step, n - 1)]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[tied] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts[tied] = new
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class Bits:
    """A bit sequence with rank: ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, rate: int = 16):
        """``text``: symbols below ``symbols``; a 0 is put behind the last run."""
        text = np.concatenate([np.asarray(text, np.int64), [0]])
        order = suffix_order(text)
        last = text[order - 1]  # of the suffix at 0: the 0 at the end
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels: list[tuple[Bits, int]] = []
        current = last
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (current >> bit & 1).astype(bool)
            self.levels.append((Bits(ones), len(current) - int(ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))
        kept = (order % rate == 0) | (last == 0)
        self.sampled, self.samples = Bits(kept), order[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place that ``at`` has among the symbols equal to ``symbol``, counted from the matrix's left."""
        bit = len(self.levels)
        for bits, zeros in self.levels:
            bit -= 1
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before ``at``."""
        return self._down(symbol, at) - self.base[symbol]

    def _step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for bits, zeros in self.levels:
            bit = bits.get(at).astype(np.int64)
            ones = bits.rank(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return self.first[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each row of ``phrases`` (symbols above 0)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled one."""
        out = np.zeros(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), np.asarray(rows, np.int64), 0
        while len(left):
            there = self.sampled.get(row).astype(bool)
            out[left[there]] = self.samples[self.sampled.rank(row[there])] + steps
            left, row = left[~there], row[~there]
            if len(left):
                row = self._step(row)
            steps += 1
        return out
