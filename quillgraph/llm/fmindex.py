"""An FM-index over a sequence of small integers: suffix order, wavelet-tree ranks, backward search.

Symbol 0 is a separator. Every separator counts as a symbol of its own, later ones
larger, so no repeat reaches over one and a search phrase never holds one. Suffix
positions are kept for every ``step``-th place and for the first place after each
separator; other rows walk back to one of those, never over a separator.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in their order, by sorting ranks of growing prefixes.
    After the first rounds only places whose rank is still shared are sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    top = int(symbols.max()) + 1
    ranks = symbols.astype(np.int64)
    apart = np.flatnonzero(symbols == 0)
    ranks[apart] = top + np.arange(len(apart))
    reach = 1
    for _ in range(2):
        bits = max(1, int(ranks.max() + 1).bit_length())
        fit = max(2, 62 // bits) if 2 * bits <= 63 else 1
        if fit == 1:
            break
        key = np.zeros(n, np.int64)
        for k in range(fit):
            key <<= bits
            if k * reach < n:
                key[: n - k * reach] |= ranks[k * reach :] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        ranks = np.empty(n, np.int64)
        ranks[order] = first
        reach *= fit
    else:
        fit = 2
    if fit == 1:
        order = np.argsort(ranks, kind="stable")
        ordered = ranks[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        at = ranks[order[slots]]
        shared = np.zeros(len(slots), bool)
        same = at[1:] == at[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        slots = slots[shared]
        if not len(slots):
            return order
        place = order[slots]
        beyond = place + reach
        key = ranks[place] * (n + 1) + np.where(beyond < n, ranks[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[slots] = place
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        ranks[place] = np.maximum.accumulate(np.where(fresh, slots, 0))
        reach *= 2


class WaveletTree:
    """Ranks of any symbol in any prefix of a sequence, level by level from the highest bit;
    each level holds its sequence's zeros before its ones."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            count = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(sequence) - int(count[-1]))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        # where each symbol's stretch begins on the last level
        self.size = len(sequence)
        self.begin = np.searchsorted(self._final(sequence), np.arange(1 << bits)) if self.size else np.zeros(1 << bits, np.int64)
        self.sequence_end = sequence

    def _final(self, sequence: np.ndarray) -> np.ndarray:
        """The last level's sequence as keys that ascend along it (the bit-reversed symbols)."""
        self.reversed = np.zeros(1 << self.bits, np.int64)
        for k in range(self.bits):
            self.reversed |= (np.arange(1 << self.bits) >> k & 1) << (self.bits - 1 - k)
        return self.reversed[sequence]

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        at = ends.astype(np.int64)
        start = np.zeros(len(at), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - k) & 1).astype(bool)
            a, s = ones[at], ones[start]
            at = np.where(bit, zeros + a, at - a)
            start = np.where(bit, zeros + s, start - s)
        return at - start

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        at = places.astype(np.int64)
        start = np.zeros(len(at), np.int64)
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] > ones[at]
            a, s = ones[at], ones[start]
            at = np.where(bit, zeros + a, at - a)
            start = np.where(bit, zeros + s, start - s)
            symbol = symbol << 1 | bit
        return symbol, at - start


class FMIndex:
    """symbols: the sequence, 0 for separators; size: one more than the largest symbol."""

    def __init__(self, symbols: np.ndarray, size: int, step: int = 8) -> None:
        self.n = len(symbols)
        order = suffix_order(symbols)
        # separators' suffixes come last; phrases never start with one, so a count by symbol with 0 at the end
        counts = np.bincount(symbols, minlength=size)
        self.before = np.concatenate([[0], np.cumsum(counts[1:])])  # before[c-1]: rows that start with a symbol under c
        previous = symbols[order - 1] if self.n else symbols
        if self.n:
            previous = np.where(order == 0, 0, previous)
        self.tree = WaveletTree(previous.astype(np.int64), max(1, int(size - 1).bit_length()))
        self.kept = (order % step == 0) | (previous == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.places = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases of one length, read from their last symbol back."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            a = self.before[symbol - 1] + self.tree.rank(symbol, low[alive])
            b = self.before[symbol - 1] + self.tree.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes of these rows."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        at, open_ = rows.astype(np.int64), np.arange(len(rows))
        while len(open_):
            done = self.kept[at]
            out[open_[done]] = self.places[self.kept_before[at[done]]] + steps[open_[done]]
            at, open_ = at[~done], open_[~done]
            steps[open_] += 1
            symbol, rank = self.tree.access(at)
            at = self.before[symbol - 1] + rank
        return out
