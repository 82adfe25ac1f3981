"""A compressed FM-index over word sequences in numpy.

The Burrows-Wheeler transform of all passages lies in a wavelet matrix of packed bits, four
bits of a symbol a level, with counts for each 64 places. Backward search extends a pattern to the left by one word; many
patterns advance in lockstep. Every passage has an owner (a document id); a pattern counts
as found only where a passage of a smaller owner holds it.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose separators (at ``ends``) all differ from each other.

    Ranks double their reach each round; only suffixes that still share a rank are sorted again.
    """
    n = len(text)
    symbol = text.astype(np.int64) + len(ends)
    symbol[ends] = np.arange(len(ends))
    width, bits = 1, int(symbol.max(initial=0) + 1).bit_length()
    key = symbol + 1
    while width < n and (width + 1) * bits <= 62:
        # As many symbols as a key can hold; 0 stands for the end of the text.
        key <<= bits
        key[: n - width] += symbol[width:] + 1
        width += 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, some, key = np.arange(n), order, key[order]
    while True:
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(new[:-1])
        rank[some] = np.repeat(slots[first], np.diff(np.append(first, len(key))))
        shared = ~(new[:-1] & new[1:])
        slots, some = slots[shared], some[shared]
        if not len(slots):
            return order
        after = some + width
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        some, key = some[again], key[again]
        order[slots] = some
        width *= 2


DIGIT = 4
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of any symbol before any place, a level for each digit of ``DIGIT`` bits of the symbols.

    A level marks each digit's places in words of 64 bits, with the place on the next level
    that the word's first one goes to.
    """

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = max(-(-int(largest).bit_length() // DIGIT), 1)
        base, words = 1 << DIGIT, len(symbols) // 64 + 1
        self.bits = np.zeros((self.levels, words, base), np.uint64)
        self.to = np.zeros((self.levels, words, base), np.int64)
        for level in range(self.levels):
            digit = ((symbols >> (DIGIT * (self.levels - 1 - level))) & (base - 1)).astype(np.uint8)
            padded = np.full(words * 64, base, np.uint8)
            padded[: len(digit)] = digit
            for d in range(base):
                self.bits[level, :, d] = np.packbits(padded == d, bitorder="little").view(np.uint64)
            count = np.bitwise_count(self.bits[level]).astype(np.int64)
            total = count.sum(axis=0)
            self.to[level] = np.cumsum(count, axis=0) - count + (np.cumsum(total) - total)
            symbols = symbols[np.argsort(digit, kind="stable")]
        everything = np.arange(largest + 1)
        self.first = self._descend(everything, np.zeros(len(everything), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            digit = (symbol >> (DIGIT * (self.levels - 1 - level))) & ((1 << DIGIT) - 1)
            slot = ((at >> 6) << DIGIT) | digit
            before = self.bits[level].ravel().take(slot) & _BELOW.take(at & 63)
            at = self.to[level].ravel().take(slot) + np.bitwise_count(before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.first.take(symbol)


class FMIndex:
    """Index of passages given as word hashes with their lengths and owners (repeats allowed)."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        self.vocabulary, word = np.unique(words, return_inverse=True)
        self.spelled = word + 1  # 0: separator
        passage = np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(words) + len(lengths), np.int64)
        text[np.arange(len(words)) + passage] = self.spelled
        ends = np.cumsum(lengths + 1) - 1
        order = suffix_order(text, ends)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], len(self.vocabulary))
        count = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.before = np.cumsum(count) - count
        # Owners by rank, with the minimum of every power-of-two stretch.
        self.owners, owner = np.unique(owners, return_inverse=True)
        least = np.repeat(owner, lengths + 1)[order].astype(np.int32)
        self.least = np.empty((self.size.bit_length(), self.size), np.int32)
        self.least[0] = least
        for level in range(1, len(self.least)):
            half, above = 2 ** (level - 1), self.least[level - 1]
            self.least[level] = above
            np.minimum(above[:-half], above[half:], out=self.least[level, :-half])

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for a word that no passage has."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` before them."""
        known = np.maximum(symbol, 0)
        both = self.wavelet.rank(np.concatenate([known, known]), np.concatenate([low, high]))
        base = self.before.take(known)
        low, high = base + both[: len(low)], base + both[len(low) :]
        return low, np.where(symbol > 0, high, low)

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner rank inside each interval; a rank beyond all for an empty one."""
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1].astype(np.int64) - 1
        row, flat = level * self.size, self.least.ravel()
        least = np.minimum(flat.take(row + low, mode="clip"), flat.take(row + high - (1 << level), mode="clip"))
        return np.where(size > 0, least, len(self.owners))

    def covered_windows(self, words: np.ndarray, lengths: np.ndarray, readers: np.ndarray, window: int) -> np.ndarray:
        """By streamed passage: bits of the window starts (bit 0: the first) found at a smaller owner."""
        return self.covered(self.symbols(words), lengths, readers, window)

    def covered(self, symbol: np.ndarray, lengths: np.ndarray, readers: np.ndarray, window: int) -> np.ndarray:
        """The same by symbols, as of :meth:`symbols` or ``spelled`` (the index's own words).

        Runs the matching statistics from the right: a pattern grows to the left as long as it
        is found; where it breaks off, windows that fit in what was found are noted, and the
        shortest found-to-fail stretch from the break (widths double) tells how far the
        pattern's end must move back. A passage has at most 62 + ``window`` words.
        """
        base = np.cumsum(lengths) - lengths
        limit = np.searchsorted(self.owners, readers)  # owners below this rank are smaller
        covered = np.zeros(len(lengths), np.int64)
        lane = np.flatnonzero(lengths >= window)
        start, below = base[lane], limit[lane]
        end = lengths[lane].copy()
        at, low, high = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        probing, broke, width, floor = np.zeros(len(lane), bool), at * 0, at * 0, at * 0
        while len(lane):
            low, high = self.extend(symbol.take(start + at - 1), low, high)
            found = self.least_owner(low, high) < below
            at = at - found
            turn = np.flatnonzero(~found | (at == floor))
            if not len(turn):
                continue

            # The patterns that ended: all others just grow on.
            f, p, a, e, b, d = found[turn], probing[turn], at[turn], end[turn], broke[turn], width[turn]
            # A growing pattern has ended: note its windows.
            long = ~p & (e - a >= window)
            first, last = a[long], (e - window)[long]
            covered[lane[turn[long]]] |= (np.int64(1) << (last + 1)) - (np.int64(1) << first)
            over = ~p & f

            # Broken off: probe from the break, one word first.
            to_probe = ~p & ~f
            b = np.where(to_probe, a - 1, b)
            # A probe that is found doubles; one that fails moves the end before itself.
            d = np.where(to_probe, 1, np.where(p & f, 2 * d, d))
            failed = p & ~f
            known = ~failed & (b + d >= e)  # that far it is known to fail
            regrow = (failed | known) & ~over
            e = np.where(failed, b + d - 1, np.where(known & regrow, e - 1, e))
            over |= regrow & (e < window)
            probing[turn], broke[turn], width[turn], end[turn] = ~regrow, b, d, e
            at[turn], floor[turn] = np.where(regrow, e, b + d), np.where(regrow, 0, b)
            low[turn], high[turn] = 0, self.size

            if over.any():
                live = np.ones(len(lane), bool)
                live[turn[over]] = False
                lane, start, below = lane[live], start[live], below[live]
                end, at, low, high = end[live], at[live], low[live], high[live]
                probing, broke, width, floor = probing[live], broke[live], width[live], floor[live]
        return covered
