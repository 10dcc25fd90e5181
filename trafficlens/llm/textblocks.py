"""Vectorised word tables over blocks of UTF-8 text, for use inside Spark tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial in its bytes modulo
2**64, passed through a mixer; all words of a block are hashed by one running sum, without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import release_worker

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _P and of its inverse, n at least. Tables for one block are kept; longer ones, for a long text, are not."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (_P, _P_INV):
        steps = np.full(max(n, BLOCK_BYTES // 4), base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    if n <= BLOCK_BYTES + 1:
        _powers[:] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Some whole documents: rows [first, last) of a batch, their bytes, and the words in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.n = first, len(offsets) - 1
        self.raw, self.offsets = data, offsets
        self.low = _LOWER[data]
        space = _SPACE[data]
        m = len(data)
        edge = np.zeros(m + 1, bool)
        edge[offsets] = True
        before = np.ones(m, bool)
        before[1:] = space[:-1]
        before |= edge[:m]
        after = np.ones(m, bool)
        after[:-1] = space[1:]
        after |= edge[1:]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.word_offsets = np.concatenate(([0], np.cumsum(self.n_words)))
        self._sums: np.ndarray | None = None

    def _running(self) -> np.ndarray:
        if self._sums is None:
            up, self._down = _power_tables(len(self.low) + 1)
            self._sums = np.zeros(len(self.low) + 1, np.uint64)
            np.cumsum(_BYTE[self.low] * up[: len(self.low)], out=self._sums[1:])
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the lower-cased bytes from start to end, for arrays of positions."""
        sums = self._running()
        return mix((sums[end] - sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole documents of about block_bytes (one long document makes its own block)."""
    release_worker()
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def shingle_hashes(block: Block, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a block (repeats kept) and their n+1 document offsets.

    A document of fewer words gives its whole word sequence as one shingle; one without words gives none.
    """
    h, n_words = block.word_hash(), block.n_words
    weights = [np.uint64(pow(_P, 3 * i + 7, 1 << 64)) for i in range(words)]
    total = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for i, w in enumerate(weights):
        total += h[i : i + len(total)] * w
    ends = block.word_offsets[1:]
    keep = np.arange(len(total)) + words <= ends[block.doc[: len(total)]]
    full, owner = mix(total[keep]), block.doc[: len(total)][keep]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(words - 1):
            has = n_words[short] > i
            extra[has] += h[block.word_offsets[short[has]] + i] * weights[i]
        full = np.concatenate((full, mix(extra + n_words[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=block.n))))
