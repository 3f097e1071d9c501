"""Table catalog of a folder of parquet tables; S8: snapshot reader."""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
_CATALOG_DDL = "table_name string, ordinal int, column_name string, data_type string"


def read_snapshot(spark: SparkSession, folder: str, tables: Sequence[str]) -> dict[str, DataFrame | None]:
    """Every listed table of a snapshot folder (``<table>.parquet`` or
    ``<table>/``); a table that isn't there (no such path, or no Parquet file in it) is
    recorded as None and does not stop the job; any other fault raises."""
    out: dict[str, DataFrame | None] = {}
    for t in tables:
        df = None
        for cand in (os.path.join(folder, f"{t}.parquet"), os.path.join(folder, t)):
            try:
                df = spark.read.parquet(cand)
                df.schema  # noqa: B018 - resolve now so a missing path fails here
                break
            except AnalysisException as e:
                if e.getCondition() not in ABSENT:
                    raise
                df = None
        out[t] = df
    return out


def table_catalog(spark: SparkSession, tables: dict[str, DataFrame | None],
                  exclude_prefix: str = "BIN$") -> DataFrame:
    """(table_name, ordinal, column_name, data_type) from the schemas, in
    ordinal order; names with the excluded prefix are skipped.  Only
    metadata is read."""
    rows = []
    for name, df in tables.items():
        if df is None or name.startswith(exclude_prefix):
            continue
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((name, i, f.name, f.dataType.simpleString()))
    return spark.createDataFrame(rows, _CATALOG_DDL)
