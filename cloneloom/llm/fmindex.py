"""An FM-index over words: suffix array, wavelet matrix of its last column, sampled suffix positions.

The text is an array of symbols: 1 and up are words, 0 ends a stretch (there is one at the end of the text).  Each 0
counts as smaller than every word and as different from all other 0s, by its place; so the suffix order is strict,
no match runs over a 0, and the step to the word before (the LF step) is exact.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A bit array with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & ONE == 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: only suffixes that still share a rank are sorted again."""
    n = len(text)
    ends = text == 0
    name = np.where(ends, np.cumsum(ends) - 1, ends.sum() + text.astype(np.int64))
    # The first sort takes two words; a 0 needs none after it.
    key = name * (n + int(text.max(initial=0)) + 2)
    key[:-1] += np.where(ends[:-1], 0, name[1:] + 1)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    left, step = order[~alone], 2
    while len(left):
        key = rank[left] * n + rank[left + step]  # no 0 is within step of a shared suffix, so this stays in the text
        by = np.argsort(key)
        left, key = left[by], key[by]
        old = key // n
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(left))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        rank[left] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        left = left[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        """text: symbols 0..symbols, a 0 at the end; every ``sample``-th place and the start of each stretch keep their position."""
        places = suffix_array(text)
        column = text.astype(np.uint16 if symbols < 1 << 16 else np.uint32)[places - 1]  # before the first word stands the last 0
        self.levels, self.zeros = [], []
        self.depth = max(1, int(symbols).bit_length())
        for level in reversed(range(self.depth)):
            bit = (column & (1 << level)) != 0
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - int(np.count_nonzero(bit)))
            column = np.concatenate([column[~bit], column[bit]])
        counts = np.bincount(text, minlength=symbols + 1)
        every = np.arange(symbols + 1)
        #: From a place in the last level's order to a row.
        self.shift = np.cumsum(counts) - counts - self._walk(every, np.zeros(symbols + 1, np.int64))
        self.rows = len(text)
        marked = (places % sample == 0) | (text[places - 1] == 0)
        self.marked, self.positions = Bits(marked), places[marked]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of the last column, of each length, ends among the copies of its symbol."""
        for level, bits, zeros in zip(reversed(range(self.depth)), self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def _before(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one word earlier."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones, one = bits.rank(at), bits.get(at)
            symbol = 2 * symbol + one
            at = np.where(one, zeros + ones, at - ones)
        return at + self.shift[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each phrase (a row of symbols, all of one length), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows)
        alive = np.arange(len(phrases))
        for i in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, i]
            low[alive] = self._walk(symbol, low[alive]) + self.shift[symbol]
            high[alive] = self._walk(symbol, high[alive]) + self.shift[symbol]
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text position of each row, by steps back to a sampled one."""
        out, left, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(left):
            found = self.marked.get(row)
            out[left[found]] = self.positions[self.marked.rank(row[found])] + steps
            left, row = left[~found], self._before(row[~found])
            steps += 1
        return out
