"""Registry of the queries the driver runs: each is a Spark builder taking
(spark, sf_dir) plus, where the result is SQL-expressible, the DuckDB text
that computes the same table from the same parquet files."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from . import round_trips, testbed  # noqa: F401
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over several tasks for each core: a file of few row groups would
    keep costly work on each row in as few tasks."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
