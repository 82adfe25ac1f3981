"""Words of whole texts as numpy arrays, shared by the text operators.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts stay UTF-8 bytes in their Arrow buffers; a batch is
cut into blocks of a few megabytes (a longer text is a block of its own), so that
memory follows the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_HASH_BYTES = 1 << 19
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0xC2B2AE3D27D4EB4F
_GRAM = 0xD6E8FEB86659FD93
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_CONTINUED = (np.arange(256) & 0xC0) == 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, 1 << 12)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _powers(_BASE, 2 * n)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts take about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte span; the spans ascend and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(end - start)
    if ends[-1] > _HASH_BYTES and len(start) > 1:
        # Eight bytes and more for each byte of text: a stretch of spans at a time.
        cut = np.searchsorted(ends, np.arange(_HASH_BYTES, ends[-1], _HASH_BYTES))
        cut = np.unique(np.concatenate([[0], cut + 1, [len(start)]]))
        cut = cut[cut <= len(start)]
        if len(cut) > 2:
            return np.concatenate([hash_spans(raw, start[a:b], end[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    length = end - start
    total = int(length.sum())
    first = np.cumsum(length) - length
    inside = np.arange(total) - np.repeat(first, length)
    at = inside + np.repeat(start, length)
    table = powers(int(length.max()))
    sums = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * table[inside], first)
    return mix(sums + length.astype(np.uint64) * _MIX[0])


class Words:
    """The words of a block: byte span, text number and hash of each, ``first`` by text."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = text_buffers(column)
        is_word = _WORD[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], is_word[:-1]]) if len(is_word) else is_word
        self.start = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.concatenate([is_word[1:], [False]]) if len(is_word) else is_word
        self.end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hash = hash_spans(self.raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def left(self) -> np.ndarray:
        """By word: how many words its text has from it on."""
        return self.first[self.text + 1] - np.arange(len(self))

    def grams(self, n: int) -> np.ndarray:
        """By word: the hash of the ``n`` words from it on (of no use if fewer are left)."""
        return grams(self.hash, n)

    def code_points(self) -> np.ndarray:
        """By word: its length in code points."""
        starts = np.concatenate([[0], np.cumsum(~_CONTINUED[self.raw])])
        return starts[self.end] - starts[self.start]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n``; the last ``n - 1`` run past the end and mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    run, width, factor, done = hashes, 1, _GRAM, 0
    while True:
        if n & width:
            shifted = np.zeros_like(run)
            shifted[: len(run) - done] = run[done:] if done else run
            out = out + shifted * np.uint64(pow(_GRAM, done, 1 << 64))
            done += width
        if done == n:
            return mix(out)
        after = np.zeros_like(run)
        after[: max(len(run) - width, 0)] = run[width:]
        run = run + after * np.uint64(factor)
        factor = factor * factor % (1 << 64)
        width *= 2


def by_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text number."""
    return np.bincount(text, values, n).astype(np.int64)
