"""Snapshot comparison as multisets and the folded report."""

from pyspark.sql import functions as F

from codeweave.operators.snapshots import (compare_catalogs, compare_snapshots, limit_then_sort, multiset_diff,
                                           order_by_first, snapshot_report)
from codeweave.sources.catalog import read_snapshot, table_catalog


def test_multiset_cases(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, float("nan")), (2, None, float("nan"))], "k int, v string, d double")
    same_other_order = a.orderBy(F.desc("k"))
    assert tuple(multiset_diff(a, same_other_order).first()) == (0, 0)
    one_more = a.unionByName(a.limit(1))
    assert tuple(multiset_diff(a, one_more).first()) == (0, 1)
    changed = a.withColumn("v", F.when(F.col("k") == 1, F.lit("y")).otherwise(F.col("v")))
    assert tuple(multiset_diff(a, changed).first()) == (1, 1)


def test_compare_snapshots_and_report(spark, scratch):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    for name, df in {"same": a, "typed": a, "only_a": a}.items():
        df.write.parquet(f"{scratch}/a/{name}.parquet")
    for name, df in {"same": a, "typed": a.withColumn("k", F.col("k").cast("long")), "only_b": a}.items():
        df.write.parquet(f"{scratch}/b/{name}.parquet")
    tables = ["same", "typed", "only_a", "only_b", "nowhere"]
    sa, sb = read_snapshot(spark, f"{scratch}/a", tables), read_snapshot(spark, f"{scratch}/b", tables)
    assert sa["nowhere"] is None and sb["only_a"] is None
    res = compare_snapshots(spark, sa, sb, tables)
    got = {r["table_name"]: r["status"] for r in res.collect()}
    assert got == {"same": "same", "typed": "schema", "only_a": "missing_b", "only_b": "missing_a"}
    rep = snapshot_report(res).first()
    assert rep["overall_same"] is False and rep["tables_compared"] == 4
    assert rep["differing_tables"] == "only_a,only_b,typed"
    cat = table_catalog(spark, {"same": sa["same"], "BIN$x": a})
    assert [tuple(r) for r in cat.collect()] == [("same", 1, "k", "int"), ("same", 2, "v", "string")]
    cmp = compare_catalogs(table_catalog(spark, sa), table_catalog(spark, sb)).collect()
    assert {(r["table_name"], r["column_name"]): r["same"] for r in cmp}[("typed", "k")] is False


def test_order_helpers(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (1, "a"), (2, "z")], "k int, v string")
    assert [tuple(r) for r in order_by_first(df).collect()] == [(1, "a"), (1, "b"), (2, "z"), (3, "c")]
    assert [tuple(r) for r in limit_then_sort(df, 2).collect()] == [(1, "a"), (1, "b")]
