"""Substring deduplication by difference-cover anchors.

A window is a run of ``window`` words of one document.  A word goes if a window over
it also starts in a document with a smaller key.

Only positions whose residue modulo ``PERIOD`` is in ``COVER`` are hashed (runs of
``window - PERIOD + 1`` words).  For any two positions some shift below ``PERIOD``
moves both onto the cover, so two equal windows share an anchor at the same place
inside them.  From there the match is extended to whole windows: only windows over
an anchor that another document has too are hashed, and the smallest document of
each window hash owns it.

Nothing is sent to all members of a group.  Anchors of one document only and owned
windows return to the one document they belong to; it removes its windows over
shared anchors that it doesn't own.  A passage that a third of all documents share
is one entry for each batch of documents, whatever their number.

Entries travel as packed columns: (bucket, keys, hashes) rows, buckets dealt out by
hash.  Their numbers follow from the bytes of text, so that a bucket stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .words import Words, covered, find, mix, per_text, pieces, window_starts, windows

WINDOW = 50
# A perfect difference set: every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BUCKET_TEXT = 4_000_000  # text bytes for each bucket
_PRIME, _SPREAD = 2_147_483_647, 2_654_435_761

_U = np.uint64
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
PACK = "bucket long, kind int, keys binary, hashes binary"


def _pack(bucket: np.ndarray, kind: int, keys: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Entries as one row for each bucket; the keys of a row ascend."""
    order = np.lexsort((keys, bucket))
    bucket, keys, hashes = bucket[order], keys[order], hashes[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket[cuts], pa.int64()), "kind": pa.array(np.full(len(cuts), kind, np.int32)),
        "keys": pa.array([_narrow(keys[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())})


def _narrow(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and distances of 4 bytes, or of 8 if they need it."""
    away = (keys - keys[0]).astype(_U)
    return keys[:1].tobytes() + away.astype("<u4" if away[-1] < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    away = np.frombuffer(data, "<u4" if len(data) == 8 + 4 * n else "<u8", n, 8)
    return np.frombuffer(data, np.int64, 1)[0] + away.astype(np.int64)


def _unpack(rows: pa.Table | pa.RecordBatch, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for k, a, b in zip(rows.column("kind").to_pylist(), rows.column("keys").to_pylist(), rows.column("hashes").to_pylist()):
        if kind is None or k == kind:
            hashes.append(np.frombuffer(b, _U))
            keys.append(_wide(a, len(hashes[-1])))
    return np.concatenate(keys), np.concatenate(hashes)


def _edges(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash with its smallest and largest key."""
    order = np.lexsort((keys, hashes))
    keys, hashes = keys[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], keys[first], keys[np.append(first[1:], len(keys))[:len(first)] - 1]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all texts."""
    size = window - PERIOD + 1
    at = window_starts(words.first, size)
    at = at[_IN_COVER[(at - words.first[words.owner[at]]) % PERIOD]]
    return at, windows(words.hash, size)[at]


def _of_document(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for (document, hash): what belongs to a document is looked up by it."""
    return mix(hashes ^ mix(key.astype(_U)))


def _home(key, buckets: int):
    """The bucket of a document, of a key column in Spark or in numpy: a spread that
    neither overflows nor depends on the library."""
    known = F.pmod(key, F.lit(_PRIME)) if isinstance(key, Column) else key % _PRIME
    spread = known * _SPREAD
    return F.pmod(F.shiftright(spread, 20), F.lit(buckets)) if isinstance(key, Column) else (spread >> 20) % buckets


def _known_rows(batch) -> tuple[np.ndarray, np.ndarray]:
    """Keys (0 for null) and which are not null."""
    key = batch.column("key")
    key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
    return key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)


def _candidates(words: Words, key: np.ndarray, known: np.ndarray, alone: np.ndarray, window: int) -> np.ndarray:
    """Positions of the windows over an anchor that isn't its document's alone."""
    at, hashes = _anchors(words, window)
    owner = words.owner[at]
    shared = known[owner] & ~np.isin(_of_document(key[owner], hashes), alone)
    flag = np.zeros(len(words.hash) + 1, np.int64)
    flag[at[shared] + 1] = 1
    before = np.cumsum(flag)
    start = window_starts(words.first, window)
    return start[before[start + PERIOD] > before[start]]


def _kept(words: Words, window: int, gone: np.ndarray):
    """Removed words, and the kept words of each text joined by one blank."""
    removed = covered(gone, window, len(words.hash))
    raw, n = words.raw.copy(), len(words.raw)
    last = np.isin(words.end, words.at[1:])
    take = np.zeros(n + 1, np.int8)
    keep = ~removed
    np.add.at(take, words.start[keep], 1)
    np.add.at(take, words.end[keep], -1)
    take = np.cumsum(take[:-1]) > 0
    blank = words.end[keep & ~last]
    raw[blank] = 0x20
    take[blank] = True
    said, bounds = raw[take], np.concatenate([[0], np.cumsum(per_text(take, words.at))])
    return removed, [said[a:b].tobytes().rstrip(b" ") for a, b in zip(bounds, bounds[1:])]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPANS), ("kept_text", pa.string())])
RESULT = "key long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_text string"


def _spans(flag: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    out = []
    for a, b in zip(bounds, bounds[1:]):
        step = np.flatnonzero(np.diff(np.concatenate([[0], flag[a:b].view(np.int8), [0]])))
        out.append(list(zip(step[::2].tolist(), step[1::2].tolist())))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, removed, kept_text) for each row: removed word spans
    (start, end) and the kept words joined by one blank.

    A null or empty text has no words.  Rows of one key never remove from each
    other; a row without a key stays whole and removes nothing.  Documents shorter
    than a window stay whole.  Other columns are not read.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET_TEXT + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                words, (own, known) = find(part.column("text")), _known_rows(part)
                at, found = _anchors(words, window)
                owner = words.owner[at]
                keys.append(own[owner][known[owner]])
                hashes.append(found[known[owner]])
            found, low, high = _edges(np.concatenate(keys), np.concatenate(hashes))
            more = low != high
            found, low = np.concatenate([found, found[more]]), np.concatenate([low, high[more]])
            yield _pack((found % _U(buckets)).astype(np.int64), 0, low, found)

    def of_one_document(group: pa.Table) -> pa.Table:
        found, low, high = _edges(*_unpack(group))
        alone = low == high
        return pa.Table.from_batches([_pack(_home(low[alone], buckets), 0, low[alone], found[alone])])

    def shared_windows(texts: pa.Table, entries: pa.Table) -> pa.Table:
        alone = _of_document(*_unpack(entries))
        keys, hashes, places = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)]
        for i, j in pieces(texts.column("text")):
            part = texts.slice(i, j - i)
            words, (own, known) = find(part.column("text")), _known_rows(part)
            start = _candidates(words, own, known, alone, window)
            keys.append(own[words.owner[start]])
            hashes.append(windows(words.hash, window)[start])
            places.append(windows(words.hash, window, 1)[start])
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        found, low, _ = _edges(np.concatenate(keys), hashes)
        order = np.argsort(hashes, kind="stable")
        place = places[order[np.searchsorted(hashes[order], found)]] if len(found) else places
        return pa.Table.from_batches([_pack((place % _U(buckets)).astype(np.int64), 1, low, found)])

    def owned(group: pa.Table) -> pa.Table:
        found, low, _ = _edges(*_unpack(group))
        return pa.Table.from_batches([_pack(_home(low, buckets), 1, low, found)])

    def cut(texts: pa.Table, entries: pa.Table) -> pa.Table:
        alone, mine = _of_document(*_unpack(entries, 0)), _of_document(*_unpack(entries, 1))
        out = []
        for i, j in pieces(texts.column("text")):
            part = texts.slice(i, j - i)
            words, (own, known) = find(part.column("text")), _known_rows(part)
            start = _candidates(words, own, known, alone, window)
            theirs = ~np.isin(_of_document(own[words.owner[start]], windows(words.hash, window)[start]), mine)
            removed, kept = _kept(words, window, start[theirs])
            out.append(pa.RecordBatch.from_arrays(
                [part.column("key").combine_chunks(), pa.array(np.diff(words.first)), pa.array(per_text(removed, words.first)),
                 pa.array(_spans(removed, words.first), _SPANS), pa.array(kept, pa.binary()).cast(pa.string())], schema=_RESULT))
        return pa.Table.from_batches(out, _RESULT)

    dealt = rows.withColumn("bucket", _home(F.coalesce("key", F.lit(0)), buckets))
    found = rows.mapInArrow(anchors, PACK).groupBy("bucket").applyInArrow(of_one_document, PACK)
    theirs = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(shared_windows, PACK) \
                  .groupBy("bucket").applyInArrow(owned, PACK)
    return dealt.groupBy("bucket").cogroup(found.unionAll(theirs).groupBy("bucket")).applyInArrow(cut, RESULT)
