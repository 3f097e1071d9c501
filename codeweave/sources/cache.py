"""Compute-once cache of derived columns (e.g. predicted skeletons),
keyed by a hash of the input text so a changed input is recomputed
(the reference trusts any existing cache file)."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string"


def text_key(text: Column) -> Column:
    """The cache's key of a text: never null, another one for null than for any text."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Batches of the cache at ``path`` that were written to their end; none where there is
    no cache.  Any other fault of the path raises."""
    try:
        return sorted(r.batch for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def materialize_missing(df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame],
                        path: str, out: str) -> DataFrame:
    """Return ``df`` with column ``out`` looked up in the cache at ``path`` by the hash of
    ``text``; keys not in the cache are computed by ``compute`` (a DataFrame of ``key``
    and ``text`` -> a DataFrame with columns ``key``, ``out``) and added first.  Only the
    missing keys reach ``compute``; a null text is a key like any other.

    Every call writes a batch of its own and then its name to the manifest, so a
    writer that dies leaves nothing that readers see.  Of keys that two writers
    computed at once, the batch with the smallest name counts.  Where nothing is
    missing, nothing is written."""
    spark = df.sparkSession
    own = [f"in{i}" for i in range(len(df.columns))]
    column = own[[c.lower() for c in df.columns].index(text.lower())]
    keyed = df.toDF(*own).withColumn("key", text_key(F.col(column)))
    before = committed(spark, path)
    todo = keyed.select("key", F.col(column).alias(text)).dropDuplicates(["key"])
    if before:
        todo = todo.join(_batches(spark, path, before).select("key"), "key", "left_anti")
    if not todo.isEmpty():
        batch = uuid.uuid4().hex
        compute(todo).select("key", out).write.parquet(f"{path}/batch-{batch}")
        spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        before = [*before, batch]
    back = [F.col(n).alias(c) for n, c in zip(own, df.columns) if c.lower() != out.lower()]
    if not before:
        return df.withColumn(out, F.lit(None).cast(compute(todo).schema[out].dataType))
    cache = _batches(spark, path, before).groupBy("key").agg(F.min_by(F.struct("value"), "batch")["value"].alias("value"))
    return keyed.join(cache, "key", "left").select(*back, F.col("value").alias(out))


def _batches(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(key, value, batch) of the named batches."""
    rows = spark.read.parquet(*(f"{path}/batch-{n}" for n in names))
    value = next(c for c in rows.columns if c != "key")
    return rows.select("key", F.col(value).alias("value"), F.regexp_extract(F.col("_metadata.file_path"), "/batch-([0-9a-f]+)/", 1).alias("batch"))
