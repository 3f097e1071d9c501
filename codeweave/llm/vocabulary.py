"""Ids of the pieces that texts are cut into: of a run of texts each distinct piece is looked up once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``flat[start[i]:start[i] + count[i]]``, one after the other."""
    end = np.cumsum(count)
    if not len(end) or not end[-1]:
        return flat[:0]
    kind = np.int32 if max(end[-1], len(flat)) < 1 << 31 else np.int64
    place = np.arange(end[-1], dtype=kind)
    place += np.repeat((start - (end - count)).astype(kind), count)
    return flat[place]


def binary_runs(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """The byte strings ``raw[at[i]:at[i + 1]]``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls."""
    if not len(column):
        return []
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data else b""
    at = (at - at[0]).tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


class Vocabulary:
    """Ids of pieces, which ``encode`` makes (of a list of pieces: all their ids, and how many
    each has).  ``first`` pieces have one id each, their place; ``room`` others are
    remembered: what comes first, and so is common, stays."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], room: int, first: list[bytes] = ()):
        self.encode, self.room = encode, room + len(first)
        self.number = {piece: i for i, piece in enumerate(first)}
        self.ids, self.start, self.count = np.arange(len(first), dtype=np.int32), np.arange(len(first)), np.ones(len(first), np.int64)
        self.used = len(first)  # of ids

    def _remember(self, pieces: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        n = len(self.number)
        pieces = pieces[:self.room - n]
        count = count[:len(pieces)]
        ids = ids[:count.sum()]
        top, end = n + len(pieces), self.used + len(ids)
        grown = lambda a, size: a if size <= len(a) else np.concatenate([a, np.empty(max(size, 2 * len(a)) - len(a), a.dtype)])
        self.ids, self.start, self.count = grown(self.ids, end), grown(self.start, top), grown(self.count, top)
        self.ids[self.used:end] = ids
        self.start[n:top] = self.used + np.cumsum(count) - count
        self.count[n:top] = count
        self.number.update(zip(pieces, range(n, top)))
        self.used = end

    def get(self, piece: bytes) -> bytes | None:
        """The ids of a piece as native 32-bit integers, if it is remembered."""
        i = self.number.get(piece)
        return None if i is None else self.ids[self.start[i]:self.start[i] + self.count[i]].tobytes()

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of a large binary array, and how many each piece has."""
        coded = pieces.dictionary_encode()
        distinct, own = byte_strings(coded.dictionary), coded.indices.to_numpy()
        del coded, pieces
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        old, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        count = np.empty(len(distinct), np.int64)
        start = np.empty(len(distinct), np.int64)
        number = number[old]
        count[old] = self.count[number]
        ids = gathered(self.ids, self.start[number], count[old])
        if len(new):
            fresh = [distinct[i] for i in new.tolist()]
            made, count[new] = self.encode(fresh)
            ids = np.concatenate([ids, made])
            if len(self.number) < self.room:
                self._remember(fresh, made, count[new])
        order = np.concatenate([old, new])
        start[order] = np.cumsum(count[order]) - count[order]
        return gathered(ids, start[own], count[own]), count[own]


def id_lists(ids: np.ndarray, count: np.ndarray, first: np.ndarray) -> pa.Array:
    """An array<int> column: row i has the ids of pieces first[i] to first[i + 1], of which
    each has ``count``."""
    end = np.concatenate([[0], np.cumsum(count)])
    return pa.ListArray.from_arrays(pa.array(end[first].astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
