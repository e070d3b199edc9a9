"""A compressed full-text index over sequences of numbers: a wavelet matrix of the Burrows-Wheeler transform, with
the matching statistics of streamed sequences by backward search."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
_QUERIES = 1 << 16


class Bits:
    """A packed bit vector that counts and finds its set bits."""

    def __init__(self, bits: np.ndarray):
        self.count = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def _place(self, words: np.ndarray, word: np.ndarray, rest: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (word << 6) + (np.cumsum(bits, axis=1) <= rest[:, None]).sum(1)

    def one(self, number: np.ndarray) -> np.ndarray:
        """The place of the set bit with ``number`` set bits before it."""
        word = np.searchsorted(self.before, number, side="right") - 1
        return self._place(self.words, word, number - self.before[word])

    def zero(self, number: np.ndarray) -> np.ndarray:
        before = (np.arange(len(self.before)) << 6) - self.before
        word = np.searchsorted(before, number, side="right") - 1
        return self._place(~self.words, word, number - before[word])


class WaveletMatrix:
    """Numbers below 2 ** width as one bit vector per bit, highest first, each level ordered by the bits before it."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels, self.zeros = [], []
        for shift in range(width - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.width = width

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros(len(at), np.int64)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            set_ = (symbol >> (self.width - 1 - level) & 1).astype(bool)
            low, high = bits.ones(begin), bits.ones(at)
            begin = np.where(set_, zeros + low, begin - low)
            at = np.where(set_, zeros + high, at - high)
        return at - begin

    def select(self, symbol: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The place of each symbol's occurrence with ``number`` occurrences before it; there must be one."""
        begin = np.zeros(len(symbol), np.int64)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            low = bits.ones(begin)
            begin = np.where(symbol >> (self.width - 1 - level) & 1, zeros + low, begin - low)
        at = begin + number
        for level in range(self.width - 1, -1, -1):
            bits, zeros = self.levels[level], self.zeros[level]
            set_ = (symbol >> (self.width - 1 - level) & 1).astype(bool)
            out = np.empty_like(at)
            out[set_], out[~set_] = bits.one(at[set_] - zeros), bits.zero(at[~set_])
            at = out
        return at


def _suffixes(ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of prefixes of 1, 2, 4 .. numbers; sequences end in numbers that occur once."""
    levels, reach = [ranks], 1
    while True:
        ranks = levels[-1]
        after = np.zeros(len(ranks), np.int64)
        after[:-reach] = ranks[reach:] + 1
        _, ranks = np.unique(ranks * (len(ranks) + 2) + after, return_inverse=True)
        if ranks.max(initial=0) == len(ranks) - 1:
            return np.argsort(ranks), [*levels, ranks]
        levels.append(ranks)
        reach *= 2


class FMIndex:
    """Sequences of numbers 1 .. ``kinds``, each with a value, ready to be searched for common stretches of ``window``.

    Kept are the transform as a wavelet matrix, how many smaller numbers there are for each number, where rows begin
    whose first ``window`` numbers differ from the row before, the least value of each such block, and the lengths that
    neighbouring rows share, up to ``window``, for least values over ranges. Suffixes themselves are not kept.
    """

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray, values: np.ndarray, kinds: int, window: int):
        count = len(numbers) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        laid = np.zeros(count, np.int64)
        inside = np.ones(count, bool)
        inside[ends] = False
        laid[inside] = numbers
        ranks = laid + len(lengths) - 1
        ranks[ends] = np.arange(len(lengths))
        order, levels = _suffixes(ranks)
        self.window = window
        shared = np.zeros(count, np.int64)
        pair = order[:-1], order[1:]
        for k in range(len(levels) - 1, -1, -1):
            if 1 << k > 2 * window:
                continue
            rank = np.append(levels[k], np.full(2 * window + 2, -1))
            left, right = (np.minimum(p + shared[1:], count) for p in pair)
            shared[1:] += ((rank[left] == rank[right]) & (rank[left] >= 0)).astype(np.int64) << k
        shared = np.minimum(shared, window).astype(np.uint8)
        self.blocks = Bits(shared < window)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.values = np.minimum.reduceat(values[owner[order]], np.flatnonzero(shared < window)) if count else values[:0]
        before = laid[order - 1]
        before[order == 0] = 0
        self.matrix = WaveletMatrix(before, max(1, int(kinds).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(laid, minlength=kinds + 1))])
        self.shortest = [shared]
        reach = 1
        while 2 * reach <= count:
            last = self.shortest[-1]
            self.shortest.append(np.minimum(last[:-reach], last[reach:]))
            reach *= 2

    def _common(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many numbers rows low < high share, up to the window."""
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.shortest[k][low[at] + 1], self.shortest[k][high[at] - (1 << k) + 1])
        return out

    def least_values(self, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per number of each streamed sequence, the least value of the indexed ones that hold the window beginning there.

        ``NONE`` stands where there is none. Sequences are read backwards, many at a time; each carries one row of the
        index and how many numbers that row shares with what was read last, its matching statistic (Gagie et al.: a
        number that does not precede the row moves to the nearest row, above or below, which it precedes).
        """
        out = np.full(len(numbers), NONE)
        order = np.argsort(-lengths, kind="stable")
        for low in range(0, len(order), _QUERIES):
            some = order[low : low + _QUERIES]
            ends, size = starts[some] + lengths[some], lengths[some]
            row, held = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            for step in range(int(size[0]) if len(size) else 0):
                active = int(np.searchsorted(-size, -step, side="left"))
                at = ends[:active] - 1 - step
                row[:active], held[:active] = self._extend(numbers[at], row[:active], held[:active])
                full = held[:active] >= self.window
                out[at[full]] = self.values[self.blocks.ones(row[:active][full] + 1) - 1]
        return out

    def _extend(self, symbol: np.ndarray, row: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number more in front of each match."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([row, row + 1]))
        rank, after = both[: len(row)], both[len(row) :]
        first, total = self.smaller[symbol], self.smaller[symbol + 1] - self.smaller[symbol]
        held = held + 1
        out = np.where(total > 0, first + np.minimum(rank, np.maximum(total - 1, 0)), 0)
        miss = np.flatnonzero(after == rank)
        if len(miss):
            best, kept = out[miss], np.zeros(len(miss), np.int64)
            above = np.flatnonzero(rank[miss] > 0)
            at = miss[above]
            kept[above] = np.minimum(held[at] - 1, self._common(self.matrix.select(symbol[at], rank[at] - 1), row[at]))
            best[above] = first[at] + rank[at] - 1
            below = np.flatnonzero(rank[miss] < total[miss])
            at = miss[below]
            length = np.minimum(held[at] - 1, self._common(row[at], self.matrix.select(symbol[at], rank[at])))
            better = (length > kept[below]) | (rank[at] == 0)
            best[below[better]], kept[below[better]] = (first[at] + rank[at])[better], length[better]
            out[miss], held[miss] = best, np.where(total[miss] > 0, kept + 1, 0)
        return out, held
