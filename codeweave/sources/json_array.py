"""A splittable reader of JSON arrays.

A file that is one array of objects has no line to split at, and a byte range of it can
begin inside a string or at any depth.  The text source cuts files at ``}`` into
ranges (it splits files of any size).  Each range is summed up for both states it
can begin in, outside or inside a string: how its depth changes, how low it gets, in
which state it ends.  These summaries, one row for each range, compose to the state
at each range's start; with it every range finds its objects.  An object that runs
over ranges belongs to the one it starts in; its parts are put together there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = np.zeros(256, np.int64)
_STEP[[0x7B, 0x5B]] = 1     # { [
_STEP[[0x7D, 0x5D]] = -1    # } ]
SUMMARY = "path string, block long, flips int, delta0 long, low0 long, delta1 long, low1 long"
PART = "path string, start long, block long, seq long, whole boolean, text binary"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(path, range, pieces between ``}``) of each run of rows of one range."""
    for batch in batches:
        paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        a = 0
        for b in range(1, len(texts) + 1):
            if b == len(texts) or (paths[b], blocks[b]) != (paths[a], blocks[a]):
                yield paths[a], blocks[a], texts[a:b]
                a = b


def _scan(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with their ``}``, and for each whether a string is open behind it, if none
    was open before.  A piece never begins behind an escape: ``}`` can't be escaped."""
    raw = np.frombuffer(b"}".join(pieces) + b"}", np.uint8)
    slash = raw == 0x5C
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
    before = np.concatenate([[-1], last[:-1]])
    escaped = (np.arange(len(raw)) - 1 - before) % 2 == 1
    return raw, np.cumsum((raw == 0x22) & ~escaped) % 2 == 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(at, s):
        return pa.RecordBatch.from_pylist([{"path": at[0], "block": at[1], "flips": s[0], "delta0": s[1], "low0": s[2], "delta1": s[3], "low1": s[4]}],
                                          pa.schema([("path", pa.string()), ("block", pa.int64()), ("flips", pa.int32()), ("delta0", pa.int64()),
                                                     ("low0", pa.int64()), ("delta1", pa.int64()), ("low1", pa.int64())]))

    now, s = None, None
    for path, block, pieces in _ranges(batches):
        if (path, block) != now:
            if now is not None:
                yield row(now, s)
            now, s = (path, block), [0, 0, 0, 0, 0]
        raw, inside = _scan(pieces)
        for k in (0, 1):  # began outside, or inside a string
            depth = s[1 + 2 * k] + np.cumsum(np.where(inside == (k ^ s[0] == 1), _STEP[raw], 0))
            s[2 + 2 * k] = min(s[2 + 2 * k], int(depth.min()))
            s[1 + 2 * k] = int(depth[-1])
        s[0] ^= int(inside[-1])
    if now is not None:
        yield row(now, s)


def starting_states(summaries: list[tuple]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(path, range) -> (string open, depth, range in which the open object began) from
    the ranges' summaries."""
    out, path, quoted, depth, began = {}, None, 0, 0, -1
    done = lambda: path is None or (quoted == 0 and depth == -1)  # noqa: E731 - behind the } added to a file's end
    for p, block, flips, delta0, low0, delta1, low1 in sorted(summaries):
        if p != path:
            if not done():
                raise ValueError(f"{path}: not a complete JSON array")
            path, quoted, depth, began = p, 0, 0, -1
        out[p, block] = (quoted, depth, began)
        delta, low = (delta1, low1) if quoted else (delta0, low0)
        if depth < 2 or depth + low < 2:   # no object was open, or it ended here
            began = block
        depth, quoted = depth + delta, quoted ^ flips
    if not done():
        raise ValueError(f"{path}: not a complete JSON array")
    return out


def _objects(states: dict):
    """Kernel: the objects of each range, and the parts of those that cross its bounds."""
    types = pa.schema([("path", pa.string()), ("start", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, depth, began, seq, held = None, 0, 0, -1, 0, []
        for path, block, pieces in _ranges(batches):
            out = []
            if (path, block) != now:
                if held:
                    out.append((now[0], began, now[1], seq, False, b"".join(held)))
                now, seq, held = (path, block), 0, []
                quoted, depth, began = states[path, block]
            raw, inside = _scan(pieces)
            if quoted:
                inside = ~inside
            steps = np.where(inside, 0, _STEP[raw])
            after = depth + np.cumsum(steps)
            starts = np.flatnonzero((steps == 1) & (after == 2) & (raw == 0x7B))
            ends = np.flatnonzero((steps == -1) & (after == 1) & (raw == 0x7D)) + 1
            data, place = raw.tobytes(), 0
            is_open = depth > 1
            if is_open and len(ends):
                held.append(data[:ends[0]])
                out.append((path, began, block, seq, began == block, b"".join(held)))
                held, ends, seq, is_open = [], ends[1:], seq + 1, False
            elif is_open:
                held.append(data)
            for place, end in zip(starts, ends):
                out.append((path, block, block, seq, True, data[place:end]))
                seq += 1
            if not is_open and len(starts) > len(ends):
                began, held = block, [data[starts[-1]:]]
            depth, quoted = int(after[-1]), int(inside[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((now[0], began, now[1], seq, False, b"".join(held)), types.types)], schema=types)

    return run


def read_json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array, parsed by ``schema`` as Spark's
    reader parses them; elements that are no objects are left out.  A file is read by
    as many tasks as Spark splits it into (``spark.sql.files.maxPartitionBytes``).  A
    file whose array doesn't end raises.  The states of the ranges, three numbers
    for each, pass through the driver."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    states = starting_states([tuple(r) for r in rows.mapInArrow(_summaries, SUMMARY).collect()])
    found = rows.mapInArrow(_objects(states), PART)
    whole = found.where("whole").select("text")
    parts = found.where("NOT whole").groupBy("path", "start").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
    joined = parts.select(F.aggregate("parts", F.lit(b""), lambda t, p: F.concat(t, p["text"])).alias("text"))
    text = F.decode("text", "utf-8")
    return whole.unionAll(joined).select(F.from_json(text, schema).alias("record")).select("record.*")
