"""Words of whole Arrow text columns, found and hashed with array operations.

A word is a maximal run of bytes other than blank and 0x09-0x0D; as those are
ASCII, the rule is the same on UTF-8 bytes and on code points.  Hashes are 64-bit
polynomials over randomised byte values, taken modulo 2**64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text bytes handled at once; bounds the temporary arrays (about 40 bytes for each
# text byte).  One longer text is a piece of its own.
PIECE_BYTES = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words: a bijection, so it merges no two values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on ``salt`` alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(salt << 32)) * _U(_BASE))


class _Powers:
    """Powers of an odd base and of its inverse, extended when a longer run comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U)
                                  for b in (self.base, self.inverse))
        return self.up, self.down


_BYTE_POWERS = _Powers(_BASE)
_WORD_POWERS = (_Powers(_STEP), _Powers(0xA0761D6478BD642F))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = seeds(256, 7)
_BYTE_VALUE[_SEPARATOR] = 0
_LOWER = np.arange(256)
_LOWER[65:91] += 32  # A-Z only
_LOWER_VALUE = _BYTE_VALUE[_LOWER]


@dataclass
class Words:
    """Words of a run of texts.

    ``raw``: all text bytes; ``at``: text i is ``raw[at[i]:at[i+1]]``;
    ``start``/``end``: byte span of each word; ``first``: words of text i are
    ``first[i]:first[i+1]``; ``hash``: 64 bits for each word.
    """

    raw: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of the column's rows with at most ``piece_bytes`` of text, or one row."""
    at = _offsets(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(at, at[i] + piece_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _strings(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk when it can't be one
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def _offsets(column) -> np.ndarray:
    column = _strings(column)
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and their bounds (null: empty)."""
    column = _strings(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts ``raw[at[i]:at[i + 1]]``, and the bounds of
    each text's words."""
    n = len(raw)
    gap = _SEPARATOR[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin, stop = ~gap, ~gap
    begin[1:] &= gap[:-1] | edge[1:n]
    stop[:-1] &= gap[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, at)


def word_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, one after the other, the bounds of each word in them, and
    the bounds of each text's words."""
    raw, at = text_bytes(column)
    if not len(raw):
        return raw, np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    start, end, first = spans(raw, at)
    return raw[~_SEPARATOR[raw]], np.concatenate([[0], np.cumsum(end - start)]), first


def find(column, lower: bool = False) -> Words:
    """Words of every text; ``lower``: hash A-Z as a-z."""
    raw, at = text_bytes(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, _U))
    start, end, first = spans(raw, at)
    if not len(start):
        return Words(raw, at, start, end, first, np.zeros(0, _U))
    up, down = _BYTE_POWERS(n)
    value = (_LOWER_VALUE if lower else _BYTE_VALUE)[raw]
    value *= up[:n]
    return Words(raw, at, start, end, first, mix(np.add.reduceat(value, start) * down[start]))


def windows(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``size`` words of a sequence (one for each start)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _WORD_POWERS[salt](len(words))
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[:len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of ``size`` words lies inside one text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    total = np.cumsum(count)
    if not len(count) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(first[:-1] - (total - count), count)


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Which of n positions lie in one of the runs [start, start + size)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + size, -1)
    return np.cumsum(depth[:-1]) > 0


def per_text(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flag`` over bounds[i]:bounds[i+1] for each i."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
