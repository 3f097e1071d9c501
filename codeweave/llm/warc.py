"""WARC archives: written by tasks, read back by byte ranges.

Every record is a gzip member of its own.  The reader deals out byte ranges of the
files; a task scans its range for the gzip magic, takes a candidate as a member
only if its decoded start is a WARC header, and owns the records that start inside
the range (the last may end behind it).  Within a range members follow each other,
so only the first is scanned for; where a member ends, the next must start.

Files go straight to the shared folder through Arrow's file systems.  Each attempt
of a task writes a file of its own; the manifest, which comes from the attempts
that Spark counts, says which files belong to the archive.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BATCH_BYTES, bounded_batches, kept_table, shared_folder

SPLIT_BYTES = 16 * 1024 * 1024
MAX_RANGES = 100_000
READ_BYTES = 1024 * 1024
HEAD_BYTES = 4096     # of a candidate, to see whether a record's header starts there
MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 1000
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(key, url, payload, digest, record_type, refers_to) for each page.

    Of equal payloads of at least ``min_bytes`` the rows with the largest key are
    responses and all others revisit it; smaller payloads and groups without any
    key are all responses.  A null payload is empty.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size") \
        .agg(F.max("key").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    revisits = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    return rows.join(groups, ["digest", "size"], "left").select(
        "key", "url", "payload", "digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("original")).alias("refers_to"))


def _urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key, url, payload: bytes, digest: str, kind: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}",
            "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one archive for each partition of ``with_revisits``'s rows; returns the
    manifest (path, bytes, records).  Partitions without rows write none."""
    spark = records.sparkSession
    bounded_batches(spark)
    folder = folder or shared_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, size, count = None, 0, 0
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for key, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store, at = pafs.FileSystem.from_uri(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)  # members are compressed one by one
                    size += out.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
                size += out.write(record(key, url, payload.encode(), digest, kind, refers_to))
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return kept_table(records.select("key", "url", "payload", "digest", "record_type", "refers_to")
                      .mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """A file's bytes from an offset on, read ahead in blocks; moving on copies nothing."""

    def __init__(self, file, start: int):
        self.file, self.base, self.held, self.place = file, start, b"", 0

    @property
    def at(self) -> int:
        return self.base + self.place

    def view(self, n: int) -> memoryview:
        """The next n bytes, fewer only at the file's end."""
        if len(self.held) - self.place < n:
            more = self.file.read_at(max(READ_BYTES, n), self.base + len(self.held))
            self.held, self.base, self.place = self.held[self.place:] + more, self.at, 0
        return memoryview(self.held)[self.place:self.place + n]


def _starts_record(data) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _first_member(window: _Window, end: int) -> bool:
    """Move to the first member that starts before ``end``; False if none does."""
    while window.at < end:
        if len(window.view(HEAD_BYTES)) < len(MAGIC):
            return False
        k = window.held.find(MAGIC, window.place)
        if k < 0:
            window.place = max(window.place + 1, len(window.held) - len(MAGIC) + 1)
            continue
        window.place = k
        if window.at < end and _starts_record(window.view(HEAD_BYTES)):
            return True
        window.place += 1
    return False


def _decoded(window: _Window, path: str) -> bytes:
    """The member at the window's place, which moves behind it."""
    start, unzip, out, step = window.at, zlib.decompressobj(31), [], HEAD_BYTES
    while not unzip.eof:
        chunk = window.view(step)
        if not chunk:
            raise ValueError(f"{path}: the member at {start} is cut off")
        try:
            out.append(unzip.decompress(chunk))
        except zlib.error as e:
            raise ValueError(f"{path}: the member at {start} is damaged: {e}") from e
        window.place += len(chunk) - len(unzip.unused_data)
        step = min(4 * step, READ_BYTES // 4)
    return b"".join(out)


def _members(window: _Window, start: int, end: int, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members that start in [start, end).  Only the first
    is searched for, and at the file's start not even that: every other one must start
    where the one before it ended, behind the range's end too.  So each member's start
    is checked by someone."""
    if start and not _first_member(window, end):
        return
    while True:
        head = window.view(HEAD_BYTES)
        if not head:
            return
        if not _starts_record(head):
            raise ValueError(f"{path}: no record starts at {window.at}, where one should")
        if window.at >= end:
            return
        yield window.at, _decoded(window, path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(urn: str | None):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def records_of(data: bytes) -> Iterator[dict]:
    """The records of a decoded member (one, as a rule): their header fields, and the
    payload behind the HTTP headers."""
    while data:
        head, gap, rest = data.partition(b"\r\n\r\n")
        fields = _fields(head)
        if not gap or not head.startswith(b"WARC/1.") or not fields.get("content-length", "").isdecimal():
            raise ValueError("a record has no header")
        size = int(fields["content-length"])
        if len(rest) < size:
            raise ValueError("a record is cut off")
        block, data = rest[:size], rest[size:].lstrip(b"\r\n")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields.get("warc-type")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        yield {"record_type": kind, "key": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
               "refers_to": _page(fields.get("warc-refers-to")), "digest": base64.b32decode(digest).hex() if digest else None,
               "payload_bytes": int(_fields(http).get("content-length", len(payload))) if block else 0,
               "payload": payload if kind == "response" else None}


_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("key", pa.int64()),
                     ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload", pa.binary())])
RECORD = ("path string, offset long, record_type string, key long, url string, refers_to long, digest string, "
          "payload_bytes long, payload binary")


def read_archives(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """The response and revisit records of files (path, bytes): path, offset (of the
    member), type, key, url, refers_to, digest (declared; hex), payload_bytes (of the
    full payload) and payload (null for revisits).

    A member that is damaged or cut off raises, with its path and offset, wherever the
    fault lies; so do bytes between members.  Ranges have ``split_bytes`` (by default
    ``SPLIT_BYTES``, or so many that all files have ``MAX_RANGES``)."""
    spark = files.sparkSession
    bounded_batches(spark)
    if split_bytes is None:
        split_bytes = max(SPLIT_BYTES, (files.agg(F.sum("bytes")).first()[0] or 0) // MAX_RANGES)
    step = F.lit(split_bytes).cast("long")
    ranges = files.where(F.col("bytes") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"),
                                                    "bytes").select("path", "start", F.least("bytes", F.col("start") + step).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    for offset, data in _members(_Window(file, start), start, end, path):
                        try:
                            found = [r for r in records_of(data) if r["record_type"] in ("response", "revisit")]
                        except ValueError as e:
                            raise ValueError(f"{path}: the member at {offset} is damaged: {e}") from e
                        rows += [{"path": path, "offset": offset, **r} for r in found]
                        held += len(data) + 200
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    tasks = max(1, ranges.count())
    return ranges.repartition(tasks).mapInArrow(run, RECORD)
