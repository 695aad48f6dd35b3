"""An FM-index over one shard of word symbols: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks and access over symbols below ``2**levels``, a level of bits at a time, vectorised over queries."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            count = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for i, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - i)) & 1 == 1
            low = np.where(bit, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[i] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for i, ones in enumerate(self.ones):
            bit = ones[high + 1] > ones[high]
            symbol = symbol * 2 + bit
            low = np.where(bit, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[i] + ones[high], high - ones[high])
        return symbol, high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; each 0 is a separator that sorts by its place.

    A comparison never passes a separator, so the rounds follow the longest stretch between two.
    """
    n = len(symbols)
    apart = symbols == 0
    rank = np.where(apart, np.cumsum(apart) - 1, symbols + int(apart.sum()))
    order = np.argsort(rank, kind="stable")
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(rank[order]) != 0]).astype(np.int64))
    step = 1
    while n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]).astype(np.int64))
        step *= 2
    return order


class FMIndex:
    """``symbols``: positive words with a 0 after every stretch; occurrences never span a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 32):
        self.n = len(symbols)
        order = suffix_array(symbols.astype(np.int64))
        before = symbols[order - 1].astype(np.int64)  # the last for the first suffix, which is a 0
        self.tree = Wavelet(before, max(1, int(sigma).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))]).astype(np.int64)
        # positions are kept at every ``sample``-th place and where a stretch begins, so that a walk ends there
        kept = (order % sample == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns (rows, left-aligned), last word first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place) of all occurrences: walk left from each suffix to a kept position."""
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), size)
        at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place, walked = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            here = at[open_]
            done = self.kept[here + 1] > self.kept[here]
            k = open_[done]
            place[k] = self.places[self.kept[at[k]]] + walked[k]
            open_ = open_[~done]
            symbol, rank = self.tree.access(at[open_])
            at[open_] = self.below[symbol] + rank
            walked[open_] += 1
        return which, place
