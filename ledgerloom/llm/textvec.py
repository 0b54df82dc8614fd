"""Vectorised words of a batch of texts: spans and 64-bit hashes straight from Arrow's buffers.

A word is a maximal run of bytes outside {0x20, 0x09..0x0D}, or of those that
a function marks; as long as it marks all bytes of a code point or none,
splitting UTF-8 bytes gives the same words as splitting code points.
Every function takes whole texts; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _series(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return out.cumprod(dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        with np.errstate(over="ignore"):
            _pow = _series(_P, size)
            _inv = _series(_PINV, size)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def parts(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 19):
    """Cut a batch into slices of about ``max_bytes`` of text, so that temporaries stay small. Nulls become empty."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at).cast(pa.large_string()).fill_null("")
    batch = batch.set_column(at, column, text)
    if not batch.num_rows:
        return
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + max_bytes, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words of the texts of one slice: ``start``/``end`` (bytes), ``hash`` and ``first`` (words before each text; one more at the end)."""

    def __init__(self, text: pa.Array, lower: bool = False, inside: Callable[[np.ndarray], np.ndarray] | None = None):
        n = len(text)
        off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        self.data, self.offsets = data, off
        word = inside(data) if inside else ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1] | cut[1:-1]
            ends[:-1] &= ~word[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        p, inv = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((_BYTE_LOW if lower else _BYTE)[data] * p[: len(data)], out=c[1:])
        self._sums, self._inv = c, inv
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``end``."""
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._inv[start] + (end - start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_Q = (0xD6E8FEB86659FD93, 0xA5A5B5C4D3E2F1A7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def combine(hashes: np.ndarray, first: np.ndarray, picks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at the offsets ``picks`` from each position, for positions whose last pick is in the same text."""
    span = picks[-1] + 1
    count = np.maximum(np.diff(first) - span + 1, 0)
    before = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first[:-1] - before[:-1], count) + np.arange(before[-1])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in picks:
            h = (h ^ hashes[at + k]) * np.uint64(_Q[0])
            h ^= h >> np.uint64(29)
        return mix(h + np.uint64(_Q[1])), before
