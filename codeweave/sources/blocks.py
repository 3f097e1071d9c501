"""Token blocks on disk.

The reference writes one flat uint16 memory map and seeks in it.  Here blocks are
Parquet rows (block_id, input_ids) in a folder for each run of ``RUN`` block ids,
written by any number of tasks, sorted inside a file: reading some ids opens the
folders of their runs only, and there only the row groups whose ids may match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import read_blocks_for_training

UINT16_MAX = 65535
RUN = 4096             # block ids of a folder; fixed for all tables that are to be read by id
GROUP_BYTES = 4 << 20  # of a Parquet row group


def write_token_blocks(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (block_id, input_ids); ids must fit the unsigned 16-bit range the
    reference stores (checked on the executors, the job fails otherwise)."""
    bad = F.exists("input_ids", lambda x: (x < 0) | (x > UINT16_MAX))
    checked = blocks.select(
        "block_id",
        F.when(bad, F.raise_error(F.lit("token id outside 0..65535"))).otherwise(F.col("input_ids"))
        .alias("input_ids"), F.floor(F.col("block_id") / RUN).alias("run"))
    checked.repartitionByRange("run").sortWithinPartitions("run", "block_id") \
        .write.mode(mode).option("parquet.block.size", GROUP_BYTES).partitionBy("run").parquet(path)


def read_token_blocks(spark: SparkSession, path: str, block_size: int | None = None, ids: Sequence[int] | None = None) -> DataFrame:
    """Blocks with labels = ids and an all-ones mask; when ``block_size`` is
    given, blocks of another length are dropped (the partial tail).  ``ids``: those
    blocks only; other runs' folders are not opened."""
    df = spark.read.parquet(path)
    if ids is not None:
        df = df.where(F.col("run").isin(sorted({i // RUN for i in ids})) & F.col("block_id").isin(*ids))
    df = df.select("block_id", "input_ids")
    if block_size is not None:
        df = df.where(F.size("input_ids") == block_size)
    return read_blocks_for_training(df)
