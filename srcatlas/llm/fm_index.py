"""A compressed FM-index over word sequences: suffix order, wavelet matrix, vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling; suffixes must differ within ``depth`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.uint64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth and n:
        behind = np.zeros(n, np.uint64)
        behind[:n - width] = rank[width:] + np.uint64(1) if width < n else 0
        key = (rank << np.uint64(32)) | behind
        order = np.argsort(key)
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0))).astype(np.uint64)
        rank[order] = new
        if int(new[-1]) == n - 1:
            break
        width *= 2
    return order


class Wavelet:
    """Bit vectors of a wavelet matrix, with a count at every 64th bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(len(values) - int(ones.sum()))
            values = np.concatenate((values[~ones], values[ones]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` comes to lie when followed through the levels along ``symbol``."""
        for level, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros)):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(bits[block] & mask)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Sequences with owners. Asks whether a sequence occurs in one with an owner below a bound."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray):
        lengths = np.array([len(s) for s in sequences])
        words = np.concatenate(sequences)
        self.words, ids = np.unique(words, return_inverse=True)
        # every sequence ends with a separator of its own; they sort before all words
        m, n = len(sequences), int(lengths.sum()) + len(sequences)
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside], text[ends] = ids + m, np.arange(m)
        order = suffix_order(text, int(lengths.max()) + 2)
        before = np.where(order > 0, text[order - 1] - m + 1, 0)
        before = np.where(before > 0, before, 0)  # 0: any separator
        symbols = len(self.words) + 1
        self.wavelet = Wavelet(before, symbols)
        first = m + np.concatenate(([0, 0], np.cumsum(np.bincount(ids, minlength=symbols - 1))))[:symbols]
        every = np.arange(symbols)
        self.base = first - self.wavelet.descend(every, np.zeros(symbols, np.int64))
        self.n = n
        level = np.repeat(owners, lengths + 1)[order]
        self.least = [level]
        while 2 << len(self.least) - 1 <= n:
            half = 1 << len(self.least) - 1
            level = np.minimum(level[:-half], level[half:])
            self.least.append(level)
        self.width = n

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that no sequence has."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol on the left."""
        both = self.wavelet.descend(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base, k = self.base[symbol], len(symbol)
        known = symbol > 0
        return np.where(known, base + both[:k], 0), np.where(known, base + both[k:], 0)

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each range; ranges must not be empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def matching_windows(index: FMIndex, queries: list[np.ndarray], bounds: np.ndarray, window: int) -> list[np.ndarray]:
    """(query, first, last) rows: windows ``first`` to ``last`` of a query occur in sequences with an owner below its bound.

    Backward search from the end of a window; a mismatch at word i rules out
    every window over it, so the next one starts behind it. A window that
    matches is widened to the longest match from its start: first to the end of
    the query, then to the mismatch, then by halving.
    """
    if not queries:
        return []
    lengths = np.array([len(q) for q in queries])
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    text = index.symbols(np.concatenate(queries))
    lane = np.flatnonzero(lengths >= window)
    size, off, bound = lengths[lane], offset[lane], bounds[lane]
    start = np.zeros(len(lane), np.int64)
    good, bad = np.zeros(len(lane), np.int64), size + 1  # longest known match from ``start``, shortest known failure
    end = start + window
    at = end.copy()
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    out = []
    while len(lane):
        at = at - 1
        low, high = index.extend(text[off + at], low, high)
        alive = high > low
        if alive.any():
            ok = np.flatnonzero(alive)
            alive[ok] = index.least_owner(low[ok], high[ok]) < bound[ok]
        hit = alive & (at == start)
        miss = ~alive
        if not (hit.any() or miss.any()):
            continue
        good = np.where(hit, end, good)
        skip = miss & (good == 0)  # not even the first window
        bad = np.where(miss & ~skip, end, bad)
        settled = (hit | miss) & ~skip & ((good == size) | (good + 1 == bad))
        for_output = np.flatnonzero(settled)
        if len(for_output):
            out.append(np.stack([lane[for_output], start[for_output], good[for_output] - window], 1))
        again = hit | miss
        probe = np.where(bad > size, size, np.where(miss & (at > good) & (at < bad), at, (good + bad) // 2))
        start = np.where(skip, at + 1, np.where(settled, good - window + 1, start))
        fresh = skip | settled
        good, bad = np.where(fresh, 0, good), np.where(fresh, size + 1, bad)
        end = np.where(fresh, start + window, np.where(again, probe, end))
        at = np.where(again, end, at)
        low, high = np.where(again, 0, low), np.where(again, index.n, high)
        done = start + window > size
        if done.any():
            keep = ~done
            lane, size, off, bound, start, good, bad, end, at, low, high = (
                x[keep] for x in (lane, size, off, bound, start, good, bad, end, at, low, high))
    return out
