"""A compressed FM-index over word ids, searched for many patterns at a time.

The index holds the Burrows-Wheeler transform of a text as a wavelet matrix: one packed bit
row per bit of a word id, with counts of ones per 64-bit word. Suffixes are sorted by their
first `depth` words only, which is enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:]
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key)
        span *= 2
        steps = np.empty(len(rank), np.int64)
        steps[0], steps[1:] = 1, key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(steps)
        if span >= min(depth, len(rank)) or rank.max() == len(rank):
            return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = max(int(n_symbols - 1).bit_length(), 1)
        self.bits: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        n_words = len(symbols) // 64 + 1
        for level in reversed(range(self.levels)):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros(n_words * 8, np.uint8)
            packed[:(len(bit) + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` lands in the last row when following the bits of `symbol`."""
        one = np.uint64(1)
        for row, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            below = self.bits[row][word] & ((one << (at & 63).astype(np.uint64)) - one)
            ones = self.ones[row][word] + np.bitwise_count(below)
            at = np.where((symbol >> level) & 1, self.zeros[row] + ones, at - ones)
        return at


class FMIndex:
    """Counts of patterns of up to `depth` symbols in a text of symbols 0 .. n_symbols - 1."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int) -> None:
        order = suffix_order(text, depth)
        self.size = len(text)
        self.wavelets = WaveletMatrix(text[order - 1], n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        every = np.arange(n_symbols)
        self.shift = np.cumsum(counts) - counts - self.wavelets.descend(every, np.zeros(n_symbols, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix ranges of symbol + pattern from those of the patterns."""
        both = np.concatenate([symbol, symbol])
        found = self.wavelets.descend(both, np.concatenate([low, high])) + self.shift[both]
        return found[:len(symbol)], found[len(symbol):]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                     window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (passage, first window, end) of windows that occur at least twice in the index.

    Every passage (a slice of text) is streamed against the index by backward search, all
    passages in step. A try extends leftwards from word `end` to the first open window `s`
    while the match occurs twice; `p` is where it broke. What broke is unique, so no window
    that contains p..end repeats; what held is a maximal repeat ending at `end`, so every
    window inside it repeats. Tries start with all open windows, then go window by window
    through unique text (which skips to p + 1) and grow again while they succeed.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who = np.flatnonzero(lengths >= window)
    base = starts[who]
    s, t = np.zeros(len(who), np.int64), lengths[who] - window  # open windows s .. t
    grow = t.copy()
    end = np.minimum(s + grow, t) + window - 1
    p, low, high = end.copy(), np.zeros(len(who), np.int64), np.full(len(who), index.size)
    while len(who):
        low, high = index.extend(text[base + p], low, high)
        held = high - low >= 2
        p = np.where(held, p - 1, p)
        won, lost = held & (p < s), ~held
        last = end - window + 1  # the last window of the try
        mark = won | (lost & (p < last))
        if mark.any():
            out.append((who[mark], np.where(won, s, p + 1)[mark], (last + 1)[mark]))
        at_edge = last == t
        single = lost & (last == s)
        s = np.where(won, last + 1, np.where(single, p + 1, s))
        t = np.where(lost & ~single & at_edge, np.where(p < last, p, last - 1), t)
        grow = np.where(won, 2 * grow + 1, np.where(lost, 0, grow))
        again = won | lost
        end = np.where(again, np.minimum(s + grow, t) + window - 1, end)
        p = np.where(again, end, p)
        low, high = np.where(again, 0, low), np.where(again, index.size, high)
        left = s <= t
        if not left.all():
            who, base, s, t, grow, end, p, low, high = (x[left] for x in (who, base, s, t, grow, end, p, low, high))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))
