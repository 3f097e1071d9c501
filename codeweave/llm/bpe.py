"""Byte-level BPE through sentencepiece.

A rank file (base64 token, rank) becomes a serialised sentencepiece BPE model:
every token is a piece whose bytes are mapped to printable characters, its score
is the negative rank, and normalisation is the identity.  Sentencepiece merges the
neighbouring pair whose joined piece scores best, leftmost first, which is the
merge rule of ranks.  Each pre-token is merged by itself, once for a run of texts; ids
decode by the inverse byte mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import column_udf, worker_store
from .vocabulary import Vocabulary, binary_runs, id_lists
from .words import pieces

# Encoded pre-tokens a Python worker remembers; others are encoded whenever they come.
CACHE_ENTRIES = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1,
    else the next unused one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, in the order of their ranks (0, 1, 2, ...)."""
    tokens = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"ranks in {path} are not 0 to {len(tokens) - 1}")
    if missing := {bytes([b]) for b in range(256)} - set(tokens.values()):
        raise ValueError(f"{path} lacks {len(missing)} single bytes")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of the tokens: piece id = rank; the unknown piece
    that the format demands comes last and is never produced."""
    mapped = byte_characters()
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("".join(mapped[b] for b in t), -float(i), 1) for i, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, 2))
    # trainer: model_type BPE, vocab_size, ids of unknown, begin, end, padding (-1: none)
    none = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, none) for k in (41, 42, 43))
    # normaliser: identity, no dummy prefix, blanks kept and not escaped
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


# The pattern whose matches are found by array operations, and its short forms.
CLASSES_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
_BLANK, _APOSTROPHE, _END = 0x20, 0x27, 4
# Bytes of new pre-tokens that sentencepiece gets at once, with a mark between them that is no piece.
_TOGETHER = 8192
_MARK = 0xE000


def _character_classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letters, 2 numbers, 3 the rest."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, of in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(of, every):
            out[found.start():found.end()] = kind
    return out


def _part_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the matches of ``CLASSES_PATTERN`` start, by code points and their classes; a
    text's end is a character of class ``_END``.  The matches leave nothing out."""
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    # the last of the white space before another character is a match of its own, or
    # (a blank) the beginning of what follows
    after = np.flatnonzero(start[1:] & (kind[:-1] == 0) & (kind[1:] != _END)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == _BLANK]] = False
    at = np.flatnonzero(start & (points == _APOSTROPHE) & (kind == 3))
    for short in _SHORT:
        here = at[at + len(short) < n]
        for i, c in enumerate(short, 1):
            here = here[points[here + i] == ord(c)]
        start[here + 1] = False
        here = here[here + len(short) + 1 < n]
        start[here + len(short) + 1] = True
    return start


class Encoder:
    """Encodes texts with the model; made once in each Python worker."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(proto)
        self.classes = _character_classes() if pattern == CLASSES_PATTERN else None
        self.split = regex.compile(pattern).findall
        mapped = byte_characters()
        self.map = np.array([ord(c) for c in mapped], "<u4")
        back = {c: b for b, c in enumerate(mapped)}
        unknown = self.model.unk_id()
        tokens = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(self.model.get_piece_size()) if i != unknown]
        self.known = Vocabulary(self._merged, CACHE_ENTRIES, tokens)

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are no token, and how many each has."""
        unknown, found = self.model.unk_id(), []
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        end = np.cumsum(size)
        bounds = np.flatnonzero(np.diff((end - size) // _TOGETHER, prepend=-1)).tolist()
        for i, j in zip(bounds, [*bounds[1:], len(parts)]):
            points = self.map[np.frombuffer(b"\0".join([*parts[i:j], b""]), np.uint8)]
            points[end[i:j] - 1 - (end[i] - size[i])] = _MARK
            found.append(np.array(self.model.encode(points.tobytes().decode("utf-32-le")), np.int32))
        ids = np.concatenate(found)
        marks = np.flatnonzero(ids == unknown)
        if len(marks) != len(parts):
            raise ValueError("sentencepiece merged over a mark")
        return ids[ids != unknown], np.diff(marks, prepend=-1) - 1

    def _parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens of the texts, and the bounds of each text's."""
        if self.classes is None:
            parts = [self.split(t) for t in texts]
            return (pa.array([p.encode() for p in chain.from_iterable(parts)], pa.large_binary()),
                    np.cumsum([0, *map(len, parts)]))
        joined = "".join([f"{t}\0" for t in texts])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        kind[ends] = _END
        start = _part_starts(points, kind)
        start[ends] = False
        # the end marks are taken out: no part holds one
        kept = kind != _END
        start = np.flatnonzero(start[kept])
        points = points[kept]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        if len(raw) > len(points):
            at = np.flatnonzero((raw & 0xC0) != 0x80)[start]
        else:
            at = start
        return binary_runs(raw, np.append(at, len(raw))), np.searchsorted(start, np.concatenate([[0], ends - np.arange(len(ends))]))

    def lists(self, column: pa.Array) -> pa.Array:
        """The ids of each text (null: none), as an array<int> column.  Piece by piece: the
        temporary arrays of a whole batch would be large."""
        found = []
        for i, j in pieces(column):
            parts, first = self._parts([t or "" for t in column.slice(i, j - i).to_pylist()])
            found.append(id_lists(*self.known(parts), first))
            del parts
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native 32-bit integers."""
        made = self.lists(pa.array(texts, pa.string()))
        at, ids = made.offsets.to_numpy(), made.values.to_numpy()
        return [ids[i:j].tobytes() for i, j in zip(at, at[1:])]


def encode(text: Column, tokens: list[bytes], pattern: str) -> Column:
    """array<int> of each whole text: every match of ``pattern`` merged by itself,
    without special tokens.  Null and empty texts give an empty array."""
    proto = model_proto(tokens)

    def run(column: pa.Array) -> pa.Array:
        made = worker_store("byte-level encoders")
        if (proto, pattern) not in made:
            made[proto, pattern] = Encoder(proto, pattern)
        return made[proto, pattern].lists(column)

    return column_udf(run, "array<int>")(text)


def decode(ids: Column, tokens: list[bytes]) -> Column:
    """Bytes of each id array, by the inverse of the mapping (null: null); an id
    that is no rank raises."""
    mapped = byte_characters()
    proto, made = model_proto(tokens), []

    def run(column: pa.Array) -> pa.Array:
        if not made:
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor()
            model.LoadFromSerializedProto(proto)
            back = str.maketrans({c: chr(b) for b, c in enumerate(mapped)})
            made.append(pa.array([model.id_to_piece(i).translate(back).encode("latin-1") for i in range(len(tokens))], pa.large_binary()))
        table = made[0]
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        bounds, out = column.offsets.to_numpy(), []
        for i, j in _runs(bounds):
            flat = column.values.slice(bounds[i], bounds[j] - bounds[i])
            if len(flat) and (flat.null_count or not (0 <= (a := flat.to_numpy()).min() and a.max() < len(table))):
                raise ValueError("an id is not in the vocabulary")
            taken = table.take(flat)
            end = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
            data = taken.buffers()[2].to_pybytes() if len(taken) else b""
            end = end[bounds[i:j + 1] - bounds[i]].tolist()
            out += [data[a:b] if v else None for a, b, v in zip(end, end[1:], valid[i:j].tolist())]
        return pa.array(out, pa.binary())

    return column_udf(run, "binary")(ids)


def _runs(bounds: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``most`` values, or one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1))
        yield i, j
        i = j


def ids_digest(ids: Column) -> Column:
    """SHA-256 (lower-case hex) of the decimal ids joined by one blank."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
