"""Execution-result comparison: table snapshots as multisets (J10, U2),
catalog comparison (J11), the folded report (A10) and the display helpers
ORDER BY 1 (L6) and limit-then-sort (L7)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RESULT_DDL = "table_name string, status string, a_only long, b_only long"


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (a_only, b_only) counting rows that are in one side more
    often than in the other.  One shuffle of the union, grouped by every
    column with a partial aggregate, so duplicated hot rows are combined
    map-side.  NULL equals NULL and NaN equals NaN, as in pandas ``equals``."""
    cols = a.columns
    u = (a.select(*cols, F.lit(1).alias("_w"))
         .unionByName(b.select(*cols, F.lit(-1).alias("_w"))))
    d = u.groupBy(*cols).agg(F.sum("_w").alias("_d")).where(F.col("_d") != 0)
    return d.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).cast("long").alias("a_only"),
                 F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).cast("long").alias("b_only"))


def compare_snapshots(spark: SparkSession, snap_a: Mapping[str, DataFrame | None],
                      snap_b: Mapping[str, DataFrame | None], tables: Sequence[str]) -> DataFrame:
    """Pair two snapshots table by table.  Both absent -> skipped; one
    absent -> ``missing_a``/``missing_b``; other column names or types ->
    ``schema``; else the multiset diff decides ``same``/``differs``."""
    parts = []
    for t in tables:
        a, b = snap_a.get(t), snap_b.get(t)
        if a is None and b is None:
            continue
        if a is None or b is None:
            status = "missing_a" if a is None else "missing_b"
            parts.append(spark.createDataFrame([(t, status, None, None)], _RESULT_DDL))
            continue
        if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
            parts.append(spark.createDataFrame([(t, "schema", None, None)], _RESULT_DDL))
            continue
        d = multiset_diff(a, b)
        parts.append(d.select(F.lit(t).alias("table_name"),
                              F.when((F.col("a_only") == 0) & (F.col("b_only") == 0), F.lit("same"))
                              .otherwise(F.lit("differs")).alias("status"),
                              "a_only", "b_only"))
    if not parts:
        return spark.createDataFrame([], _RESULT_DDL)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_report(results: DataFrame) -> DataFrame:
    """A10: overall flag, tables compared and the sorted list of differing
    table names."""
    return results.agg(
        F.coalesce(F.bool_and(F.col("status") == "same"), F.lit(True)).alias("overall_same"),
        F.count(F.lit(1)).cast("long").alias("tables_compared"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "same", F.col("table_name")))),
                     ",").alias("differing_tables"))


def compare_catalogs(cat_a: DataFrame, cat_b: DataFrame,
                     keys: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """Full outer join of two catalog tables on their keys (null-safe);
    returns the keys with ``in_a``/``in_b``/``same`` flags."""
    keys = list(keys)
    vals = [c for c in cat_a.columns if c not in keys]
    a = cat_a.select(*keys, F.struct(*vals).alias("_va"))
    b = cat_b.select(*keys, F.struct(*vals).alias("_vb"))
    cond = [a[k].eqNullSafe(b[k]) for k in keys]
    j = a.join(b, cond, "full_outer")
    return j.select(*[F.coalesce(a[k], b[k]).alias(k) for k in keys],
                    a["_va"].isNotNull().alias("in_a"), b["_vb"].isNotNull().alias("in_b"),
                    F.coalesce(a["_va"].eqNullSafe(b["_vb"]), F.lit(False)).alias("same"))


def order_by_first(df: DataFrame) -> DataFrame:
    """ORDER BY 1 (all columns as tie-breakers, so the order is total)."""
    return df.orderBy(*df.columns)


def limit_then_sort(df: DataFrame, n: int) -> DataFrame:
    """Sort first, then keep n rows, so the kept rows are deterministic
    (the reference filters ``ROWNUM <= n`` before ``ORDER BY``)."""
    return df.orderBy(*df.columns).limit(n)
