"""Compute-once cache, similarity dump, long task tables and their rebuild."""

import json

from pyspark.sql import functions as F

from codeweave.operators.prompts import schema_sequence
from codeweave.sources.cache import materialize_missing
from codeweave.sources.similarity_sink import read_similarity, write_similarity
from codeweave.sources.tasks import foreign_keys, read_tasks, rebuild_schema, schema_columns, schema_tables

from .test_prompts import GOLDEN, TASK


def test_materialize_missing_computes_only_new_keys(spark, scratch):
    calls = []

    def compute(todo):
        calls.append(todo.count())
        return todo.select("key", F.upper("text").alias("sk"))
    path = f"{scratch}/cache"
    a = spark.createDataFrame([("x",), ("y",)], "text string")
    out = materialize_missing(a, "text", compute, path, "sk")
    assert sorted(r["sk"] for r in out.collect()) == ["X", "Y"]
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "text string")
    out = materialize_missing(b, "text", compute, path, "sk")
    assert sorted(r["sk"] for r in out.collect()) == ["Y", "Z", "Z"]
    assert calls == [2, 1]


def test_similarity_round_trip(spark, scratch):
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 0, 1.0), (1, 0, None)], "eval_id long, demo_id long, sim double")
    write_similarity(pairs, f"{scratch}/sim")
    assert sorted(map(str, read_similarity(spark, f"{scratch}/sim").collect())) == sorted(map(str, pairs.collect()))


def test_long_tables_roundtrip(spark, scratch):
    path = f"{scratch}/t.json"
    with open(path, "w") as f:
        json.dump([TASK], f)
    tasks = read_tasks(spark, path)
    tb = schema_tables(tasks).withColumn("table_rank", F.col("table_pos") + 1)
    co = schema_columns(tasks).withColumn("col_rank", F.col("col_pos") + 1)
    assert [r["label"] for r in co.orderBy("table_pos", "col_pos").collect()] == [0, 1, 1, 0, 0]
    fk = foreign_keys(tasks)
    rebuilt = rebuild_schema(tb, co, fk)
    assert rebuilt.select(schema_sequence("schema")).first()[0] == GOLDEN


def test_task_layouts(spark, tmp_path):
    import json

    import pytest

    from codeweave.sources.tasks import read_tasks
    records = [{"task_id": i, "text": f"t{i}", "matched_contents": {"a.b": ["x"]}} for i in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    for layout in ("lines", "array"):
        got = read_tasks(spark, str(tmp_path / f"{layout}.json"), layout).select("task_id", "matched_contents").collect()
        assert sorted(r["task_id"] for r in got) == list(range(5)) and got[0]["matched_contents"] == {"a.b": ["x"]}
    with pytest.raises(ValueError, match="layout"):
        read_tasks(spark, "x", "csv")


def test_cache_of_nulls_and_reruns(spark, scratch):
    import os
    calls = []

    def compute(todo):
        calls.append(sorted(r["text"] or "-" for r in todo.collect()))
        return todo.select("key", F.coalesce(F.upper("text"), F.lit("NONE")).alias("sk"))
    path = f"{scratch}/nulls"
    df = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("null", 3, "z"), (None, 4, "w")], "text string, key int, value string")
    for _ in range(3):
        out = materialize_missing(df, "text", compute, path, "sk")
        assert out.columns == ["text", "key", "value", "sk"]
        assert sorted((r["key"], r["sk"], r["value"]) for r in out.collect()) == [(1, "A", "x"), (2, "NONE", "y"), (3, "NULL", "z"), (4, "NONE", "w")]
    assert calls == [["-", "a", "null"]]
    assert len([d for d in os.listdir(path) if d.startswith("batch-")]) == 1


def test_cache_of_killed_and_parallel_writers(spark, scratch):
    from codeweave.sources.cache import committed
    path = f"{scratch}/writers"
    df = spark.createDataFrame([("a",), ("b",)], "text string")

    def fails(todo):
        return todo.select("key", F.when(F.col("text") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("text")).alias("sk"))

    import pytest
    with pytest.raises(Exception, match="killed"):
        materialize_missing(df, "text", fails, path, "sk")
    assert committed(spark, path) == []
    def parallel(todo):  # another writer commits the same keys meanwhile
        materialize_missing(df, "text", lambda t: t.select("key", F.lit("first").alias("sk")), path, "sk")
        return todo.select("key", F.lit("second").alias("sk"))
    out = materialize_missing(df, "text", parallel, path, "sk").collect()
    assert len(out) == 2 and len({r["sk"] for r in out}) == 1 and len(committed(spark, path)) == 2


def test_snapshot_faults_are_not_absence(spark, scratch):
    import os

    import pytest

    from codeweave.sources.catalog import read_snapshot
    os.makedirs(f"{scratch}/snap/broken", exist_ok=True)
    with open(f"{scratch}/snap/broken/part.parquet", "w") as f:
        f.write("no parquet")
    assert read_snapshot(spark, f"{scratch}/snap", ["absent"]) == {"absent": None}
    with pytest.raises(Exception):
        read_snapshot(spark, f"{scratch}/snap", ["broken"])["broken"].collect()


def test_some_blocks_open_their_folders_only(spark, scratch, monkeypatch):
    from codeweave.sources import blocks
    monkeypatch.setattr(blocks, "RUN", 100)
    path = f"{scratch}/runs"
    data = spark.range(5000).select(F.col("id").alias("block_id"), F.array(F.col("id").cast("int"), F.lit(7)).alias("input_ids"))
    blocks.write_token_blocks(data.repartition(7), path)
    wanted = [101, 103, 150, 199, 4200]
    some = blocks.read_token_blocks(spark, path, ids=wanted)
    assert sorted((r.block_id, list(r.input_ids)) for r in some.collect()) == [(i, [i, 7]) for i in wanted]
    opened = spark.read.parquet(path).where(F.col("run").isin(1, 42)).select("_metadata.file_path").distinct().count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert opened == 2 and "PartitionFilters: [run" in plan and "In(block_id" in plan
    assert blocks.read_token_blocks(spark, path).count() == 5000
    import pytest
    with pytest.raises(Exception, match="outside 0..65535"):
        blocks.write_token_blocks(spark.createDataFrame([(1, [70000])], "block_id long, input_ids array<int>"), f"{scratch}/bad")
