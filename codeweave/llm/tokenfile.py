"""Token files compressed by Re-Pair grammars.

Documents are sorted by key, their ids joined to blocks of about ``BLOCK_TOKENS``
(whole documents), and every block gets a grammar of its own: each round replaces
frequent neighbouring pairs by new symbols, all pairs that are locally most
frequent at once, until no pair is frequent.  A block is a row of a Parquet table:
the documents' keys and lengths, the rules, the expansion length of every symbol a
rule defines, and the remaining sequence.  The lengths give the place of any token
without expanding what stands before it.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_characters
from .frames import bounded_batches, column_udf, spare_memory, worker_store
from .vocabulary import Vocabulary, binary_runs
from .words import pieces, word_bytes

BLOCK_TOKENS = 1 << 20
MIN_COUNT = 16    # replacements that make a rule worth its place
SLOTS = 20        # bits of the table that sorts out rare pairs before they are counted
CACHE_ENTRIES = 500_000

# Letters that every Unicode version takes for letters, that composition leaves alone
# and that lower-case one by one (Latin; without U+0130).
_PLAIN = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


class WordEncoder:
    """Texts to ids, each distinct word of a run of texts looked up once.

    A word of plain letters and closing punctuation is two pre-tokens, whose merges
    are looked up directly; any other goes through the whole tokenizer."""

    def __init__(self, spec: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.plain = re.compile(_PLAIN).fullmatch
        self.bytes = str.maketrans(dict(enumerate(byte_characters())))
        self.closing: dict[str, bytes] = {"": b""}
        self.known = Vocabulary(self._new, CACHE_ENTRIES)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _signs(self, signs: str) -> bytes:
        ids = self.closing.get(signs)
        if ids is None:
            ids = self._whole([signs])[0]
            if len(self.closing) < 10_000:
                self.closing[signs] = ids
        return ids

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        merge, plain, known, stems = self.tokenizer.model.tokenize, self.plain, self.known.get, {}
        runs, rest = [], []
        for word in b"\n".join(words).decode().split("\n"):
            stem = word.rstrip(".,;:!?")
            low = stem.lower()
            ids = stems.get(low) if stem.isascii() else None
            if ids is None:
                if not plain(stem):
                    rest.append(len(runs))
                    runs.append(word)
                    continue
                ids = stems.get(low)
                if ids is None:
                    coded = low.encode()
                    ids = known(coded)  # a plain word by itself has the same merges
                    if ids is None:
                        mapped = low if low.isascii() else coded.decode("latin-1").translate(self.bytes)
                        ids = array("i", [t.id for t in merge(mapped)]).tobytes()
                    stems[low] = ids
            runs.append(ids + self._signs(word[len(stem):]) if len(stem) < len(word) else ids)
        for i, ids in zip(rest, self._whole([runs[i] for i in rest])):
            runs[i] = ids
        return np.frombuffer(b"".join(runs), np.int32), np.fromiter(map(len, runs), np.int64, len(runs)) // 4

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and the bounds of each text's."""
        found = [word_bytes(texts.slice(i, j - i)) for i, j in pieces(texts)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words = pa.concat_arrays([binary_runs(raw, at) for raw, at, _ in found])
        size = np.concatenate([np.diff(first) for _, _, first in found])
        del found
        ids, count = self.known(words)
        return ids, np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(size)])]


def _encoder(spec: str) -> WordEncoder:
    made = worker_store("word encoders")
    if spec not in made:
        made[spec] = WordEncoder(spec)
    return made[spec]


def encode_words(text: Column, tokenizer_path: str) -> Column:
    """array<int> of each whole text by a tokenizer file of the tokenizers library that
    lower-cases, drops white space, and takes runs of letters or of signs as
    pre-tokens; without special tokens.  Null and empty texts give an empty array."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()

    def run(column: pa.Array) -> pa.Array:
        ids, bounds = _encoder(spec)(column)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    return column_udf(run, "array<int>")(text)


@dataclass
class Grammar:
    """``sequence`` over ids below ``base`` and symbols base + k, which stand for the
    pair ``rules[k]`` and expand to ``lengths[k]`` ids."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids each symbol expands to."""
        own = symbols >= self.base
        out = np.ones(len(symbols), np.int64)
        out[own] = self.lengths[symbols[own] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols."""
        while len(own := np.flatnonzero(symbols >= self.base)):
            pair = self.rules[symbols[own] - self.base]
            symbols = np.insert(symbols, own + 1, pair[:, 1])
            symbols[own + np.arange(len(own))] = pair[:, 0]
        return symbols

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``; only the symbols that hold them are expanded."""
        ends = np.cumsum(self.sizes(self.sequence))
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, start + count, "left")) + 1
        zero = ends[first - 1] if first else 0
        return self.expand(self.sequence[first:last])[start - zero:start - zero + count]


def _mixed(codes: np.ndarray) -> np.ndarray:
    """64 bits for each code, different for different codes."""
    return codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _replaced(at: np.ndarray, own: np.ndarray, pairs: int, measure: np.ndarray, least: int,
              min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` (ascending) of pairs ``own``: those, without overlap, of pairs of
    ``least`` measure that no overlapping pair's exceeds (of ties in a row every second), and
    which pair is there; ``min_count`` or more of each."""
    weight = measure[own]
    apart = np.diff(at) != 1
    best = weight >= least
    best[1:] &= apart | (weight[1:] >= weight[:-1])
    best[:-1] &= apart | (weight[:-1] >= weight[1:])
    place, kind = at[best], own[best]
    run = np.maximum.accumulate(np.where(np.diff(place, prepend=-2) != 1, place, 0))
    even = (place - run) % 2 == 0
    place, kind = place[even], kind[even]
    enough = (np.bincount(kind, minlength=pairs) >= min_count)[kind]
    return place[enough], kind[enough]


def re_pair(ids: np.ndarray, min_count: int = MIN_COUNT) -> Grammar:
    """Grammar of a sequence of ids.  In each round a pair is replaced where it is more
    frequent than the pairs that overlap it, if that happens ``min_count`` times or more;
    the rounds end when no pair has so many places without overlap.  A pair that is not
    frequent in one round never becomes so: later rounds look at frequent pairs and at
    those of new symbols."""
    sequence = ids.astype(np.int64)
    base = int(sequence.max()) + 1 if len(sequence) else 0
    grammar = Grammar(base, np.zeros((0, 2), np.int64), np.zeros(0, np.int64), sequence)
    open_ = np.arange(max(0, len(sequence) - 1))  # places of pairs that may be frequent
    while len(open_):
        sequence, top = grammar.sequence, base + len(grammar.rules)
        left, right = sequence[open_], sequence[open_ + 1]
        codes, equal = left * top + right, left == right
        del left, right
        slot = (_mixed(codes) >> np.uint64(64 - SLOTS)).view(np.int64)
        often = (np.bincount(slot, minlength=1 << SLOTS) >= min_count)[slot]  # no frequent pair is lost
        del slot
        open_, codes, same = open_[often], codes[often], np.flatnonzero(equal[often])
        run = np.flatnonzero(np.diff(open_[same], prepend=-2) != 1)
        nth = np.arange(len(same)) - np.repeat(run, np.diff(run, append=len(same)))
        second = same[nth % 2 == 1]
        counted = np.ones(len(open_), bool)
        counted[second] = False  # in a run of equals every second
        at = open_[counted]
        codes = codes[counted]
        del often, equal, same, run, nth
        pairs, own, count = np.unique(codes, return_inverse=True, return_counts=True)
        del codes
        frequent = count >= min_count
        if not frequent.any():
            break
        still = np.empty(len(open_), bool)
        still[counted] = frequent[own]
        still[second] = still[second - 1]
        place, kind = _replaced(at, own, len(pairs), count, min_count, min_count)
        if not len(place):  # ties cut every pair's places: by rank the most frequent pair gets all of its own
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((_mixed(pairs), count))] = np.arange(1, len(pairs) + 1)
            place, kind = _replaced(at, own, len(pairs), np.where(frequent, rank, 0), 1, min_count)
        used = np.bincount(kind, minlength=len(pairs)) > 0
        fresh = np.flatnonzero(used)
        symbol = top + np.cumsum(used) - 1
        rules = np.stack([pairs[fresh] // top, pairs[fresh] % top], axis=1)
        lengths = grammar.sizes(rules.ravel()).reshape(-1, 2).sum(axis=1)
        sequence = sequence.copy()
        sequence[place] = symbol[kind]
        kept, live = np.ones(len(sequence), bool), np.zeros(len(sequence), bool)
        kept[place + 1] = False
        live[open_[still]] = True
        live[place] = True
        live[place[place > 0] - 1] = True
        open_ = np.flatnonzero(live[kept][:-1])
        grammar = Grammar(base, np.concatenate([grammar.rules, rules]), np.concatenate([grammar.lengths, lengths]), sequence[kept])
    return grammar


BLOCK = ("shard int, block int, tokens long, keys array<long>, counts array<long>, base int, rules binary, lengths binary, "
         "sequence binary, width int")
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("tokens", pa.int64()), ("keys", pa.list_(pa.int64())),
                    ("counts", pa.list_(pa.int64())), ("base", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()),
                    ("sequence", pa.binary()), ("width", pa.int32())])


def _block(shard: int, block: int, keys: list, runs: list[np.ndarray]) -> pa.RecordBatch:
    g = re_pair(np.concatenate(runs))
    width = 2 if g.base + len(g.rules) <= 1 << 16 else 4
    packed = lambda a: a.astype(f"<u{width}").tobytes()
    return pa.RecordBatch.from_pylist([{
        "shard": shard, "block": block, "tokens": sum(map(len, runs)), "keys": keys, "counts": [len(r) for r in runs], "base": g.base,
        "rules": packed(g.rules), "lengths": g.lengths.astype("<u4").tobytes(), "sequence": packed(g.sequence), "width": width}], _BLOCK)


def _blocks(documents: Iterator[tuple], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's documents (key, ids)."""
    shard, block, held, keys, runs = TaskContext.get().partitionId(), 0, 0, [], []
    for key, ids in documents:
        keys.append(key)
        runs.append(ids)
        held += len(ids)
        if held >= block_tokens:
            yield _block(shard, block, keys, runs)
            block, held, keys, runs = block + 1, 0, [], []
    if keys:
        yield _block(shard, block, keys, runs)


def to_blocks(ids: DataFrame, key: str = "doc_id", column: str = "ids", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (``BLOCK``) of rows (key, ids) that are already in order within their
    partitions, partitions ascending.  A block ends with the document that fills it."""
    bounded_batches(ids.sparkSession)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(batch.column(0).to_pylist()):
                yield k, flat[at[i]:at[i + 1]].copy()

    return (ids.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<int>").alias("ids"))
            .mapInArrow(lambda batches: _blocks(documents(batches), block_tokens), BLOCK))


def text_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text",
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole texts, as ``to_blocks`` makes them of ``encode_words`` with
    ``end_id`` appended, in ascending order of key (null first; equal keys by text).
    One Python worker encodes and compresses: the ids never travel."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = _encoder(spec)
        for batch in batches:
            ids, bounds = encoder(batch.column(1))
            spare_memory()
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = (bounds + np.arange(len(bounds))).tolist()
            for key, i, j in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                yield key, ids[i:j]

    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    return (ordered.select(F.col("key").cast("long").alias("key"), "text")
            .mapInArrow(lambda batches: _blocks(documents(batches), block_tokens), BLOCK))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the blocks of every whole text (``text_blocks``) to ``path``."""
    text_blocks(docs, tokenizer_path, end_id, key, text).write.parquet(path)


def grammar_of(row: dict) -> Grammar:
    """The grammar of a block's row."""
    unpacked = lambda b: np.frombuffer(b, f"<u{row['width']}").astype(np.int64)
    return Grammar(row["base"], unpacked(row["rules"]).reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64),
                   unpacked(row["sequence"]))


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, start): ids in all blocks before.  Within shards first, then over
    one row for each shard."""
    inside = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", "tokens")
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("all")).withColumn("zero", F.coalesce(F.sum("all").over(before), F.lit(0)))
    return sizes.withColumn("in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(shards, "shard") \
                .select("shard", "block", (F.col("zero") + F.col("in")).alias("start"))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _little_endian(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = pa.py_buffer(ids.astype("<u4"))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), data])


def read_tokens(blocks: DataFrame, packed: bool = False) -> DataFrame:
    """(key, start, ids) of every document of the blocks: ``start`` counts the ids of all
    documents before it.  ``packed``: the ids as binary, little-endian unsigned 32-bit
    integers, which Spark's own functions digest without another Python worker."""
    bounded_batches(blocks.sparkSession)
    column, kind = (_little_endian, "binary") if packed else (_lists, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = grammar_of(row)
                ids = g.expand(g.sequence)
                ends = np.cumsum(row["counts"])
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(row["keys"], pa.int64()), "start": pa.array(row["start"] + ends - row["counts"], pa.int64()),
                    "ids": column(ids, np.concatenate([[0], ends]))})
                del row, g, ids, ends
                spare_memory()

    return blocks.join(block_starts(blocks), ["shard", "block"]).mapInArrow(run, f"key long, start long, ids {kind}")


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    def run(column: pa.Array) -> pa.Array:
        import zlib
        at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(flat[at[i]:at[i + 1]].tobytes()) for i in range(len(column))], pa.int64())

    return column_udf(run, "long")(ids)
