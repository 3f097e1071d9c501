"""Write and read similarities as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIRS = "eval_id long, demo_id long, sim double"


def write_similarity(pairs: DataFrame, path: str) -> None:
    """``pairs(eval_id, demo_id, sim)`` as Parquet, one row for each pair: usually the
    ranked survivors of ``topk_similar``.  No row of the matrix ever meets in one
    task, as a line of text for each eval would need."""
    pairs.select("eval_id", "demo_id", "sim").write.mode("overwrite").parquet(path)


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """The pairs that ``write_similarity`` wrote."""
    return spark.read.schema(PAIRS).parquet(path)
