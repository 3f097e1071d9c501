"""Small helpers shared by the operators: sessions, Arrow batches, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes of a column batch handed to a Python kernel.
BATCH_BYTES = 4 * 1024 * 1024
# Bytes of rows that a kernel collects before it packs them.
PACKED_BYTES = 16 * 1024 * 1024
_NOTED: list[list[str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spare_memory() -> None:
    """Hand freed memory back to the system.  A Python worker lives on after its tasks and
    shares the executor's memory with others, so what it no longer needs must not stay."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session by bytes, so that many long texts
    never stand in one batch (a single longer text still travels alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` over every Arrow batch; it yields any number of result batches."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)
                spare_memory()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the cluster names in
    ``spark.checkpoint.dir`` (a session in one process has a scratch one)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, purpose: str, lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage
    at a copy that outlives any executor.  ``lean``: smaller files (zstd), and what the
    write has shuffled is dropped as soon as it is done, not when the driver's memory
    happens to be cleaned."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    for folders in _NOTED:
        folders.append(path)
    if not lean:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The folders of the tables that are kept meanwhile, for ``remove_tables``."""
    folders: list[str] = []
    _NOTED.append(folders)
    try:
        yield folders
    finally:
        _NOTED[:] = [f for f in _NOTED if f is not folders]


def remove_tables(spark: SparkSession, folders: list[str]) -> None:
    """Remove kept tables that nothing reads any more: whatever came of them is kept."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_rows(rows: pa.Table, bytewise: tuple[str, ...] = ()) -> bytes:
    """A table as bytes that a shuffle moves as they are: Parquet in memory, so that
    numbers and texts that occur often cost little.  ``bytewise``: columns of lists of
    small numbers, of which all first bytes stand together, all second ones and so on."""
    out, apart = pa.BufferOutputStream(), [f"{c}.list.element" for c in bytewise]
    dictionaries = [c for c in _leaves(rows.schema) if c not in apart] if apart else True
    pq.write_table(rows, out, compression="zstd", compression_level=6, dictionary_pagesize_limit=PACKED_BYTES, write_statistics=False,
                   use_dictionary=dictionaries, column_encoding={c: "BYTE_STREAM_SPLIT" for c in apart} or None)
    return out.getvalue().to_pybytes()


def _leaves(schema: pa.Schema) -> list[str]:
    """Parquet's names of the innermost columns."""
    out = pa.BufferOutputStream()
    pq.write_table(schema.empty_table(), out)
    columns = pq.ParquetFile(pa.BufferReader(out.getvalue())).schema
    return [columns.column(i).path for i in range(len(columns))]


def unpacked_rows(packed: bytes) -> pa.Table:
    return pq.read_table(pa.BufferReader(packed), use_threads=False)


def renamed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[Column]]:
    """``df`` with its columns called in0, in1, ..., what ``names`` are called there, and the
    columns that give the table back: an operator's own columns then clash with none."""
    own = [f"in{i}" for i in range(len(df.columns))]
    at = {c.lower(): n for c, n in zip(df.columns, own)}
    return df.toDF(*own), [at[n.lower()] for n in names], [F.col(n).alias(c) for n, c in zip(own, df.columns)]


def column_udf(kernel: Callable[[pa.Array], pa.Array], returns: str):
    """An Arrow function of whole columns as a Spark column function."""
    def run(column: pa.Array) -> pa.Array:
        out = kernel(column)
        spare_memory()
        return out

    return F.arrow_udf(run, returns)


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, which runs many tasks: for
    loaded models and bounded caches.  Results never depend on what it holds."""
    import sys
    import types

    return vars(sys.modules.setdefault("_codeweave_worker", types.ModuleType("_codeweave_worker"))).setdefault(name, {})
