"""A corpus pipeline over ``documents``: quality rules, exact and near
deduplication, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import bpe, exact, mixing, neardup, repetition
from codeweave.llm.frames import bounded_batches, kept_table, renamed

RANKS = "byte_bpe_50k.tiktoken"
LIKE = neardup.Likeness(80, 100, 5)
WEIGHTS, MAX_REPEATS = [5, 2, 1], 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules accept."""
    bounded_batches(spark)
    rows, (text,), back = renamed(docs, "text")
    judged = rows.withColumn("measured", repetition.repetition(F.col(text)))
    return judged.where(repetition.accepted(F.col("measured"))).select(*back)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to the case of A-Z the one with the largest doc_id."""
    return exact.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return neardup.without_near_duplicates(docs, like=LIKE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, WEIGHTS, MAX_REPEATS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    bounded_batches(spark)
    tokens = bpe.load_ranks(public_tokenizers.path(RANKS))
    ids = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")) \
              .withColumn("ids", bpe.encode(F.col("text"), tokens, public_tokenizers.PATTERN))
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      (bpe.decode(F.col("ids"), tokens) == F.encode("text", "utf-8")).alias("round_trip"))


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
          ("mix", mix), ("byte-level BPE", tokenize)]

# near duplicates and merges have no SQL of reasonable cost; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept_table(docs, f"stage-{k}")
    return docs
