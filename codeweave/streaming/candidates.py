"""Structured Streaming use of the row-wise operators.

The reference has no streams; its row-wise steps (cleaning, normalising,
fingerprinting) apply to a streaming DataFrame as they are.  This job picks
up candidate logs as they land (parquet files of ``task_id, cand_pos, code,
error`` plus the task's schema terms), cleans every candidate and adds its
fingerprint, and appends the rows to a parquet sink.  Progress is kept in the
shared checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.code import clean_candidate, code_fingerprint
from ..session import ensure_checkpoint_dir

CANDIDATE_LOG_DDL = "task_id long, cand_pos int, code string, error string, terms array<string>"


def cleaned_candidates(stream: DataFrame, dialect: str = "oracle") -> DataFrame:
    """Row-wise: cleaned code and its structural fingerprint."""
    cleaned = stream.withColumn("cleaned", clean_candidate("code", "terms", dialect))
    return cleaned.withColumn("fingerprint", code_fingerprint("cleaned", dialect)).drop("terms")


def start_candidate_stream(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "candidates",
                           dialect: str = "oracle", available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes every file that
    is there and stops (a restartable batch), else it keeps polling."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    src = (spark.readStream.schema(CANDIDATE_LOG_DDL).option("maxFilesPerTrigger", 1000)
           .parquet(source_dir))
    writer = (cleaned_candidates(src, dialect).writeStream.format("parquet")
              .option("checkpointLocation", ckpt).option("path", sink_dir).outputMode("append")
              .queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
