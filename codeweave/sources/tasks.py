"""Task records (a JSON array of nested records) read with a declared
schema, and their long working tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_array import read_json_array

# Declared, never inferred: inference turns matched_contents into a struct.
TASK_DDL = (
    "task_id long, text string, concise_text string, detailed_text string, plsql string, call array<string>, "
    "database string, `table` array<string>, skeleton string, "
    "schema struct<schema_items:array<struct<table_name:string,table_comment:string,"
    "column_names:array<string>,column_types:array<string>,column_comments:array<string>,"
    "column_contents:array<array<string>>,pk_indicators:array<int>>>,foreign_keys:array<array<string>>>, "
    "table_num int, parameter int, insert int, `select` int, `update` int, `delete` int, `if` int, loop int, "
    "declare int, table_labels array<int>, column_labels array<array<int>>, "
    "matched_contents map<string,array<string>>"
)


def read_tasks(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Read task files.  ``layout`` is ``"array"`` (one JSON array in each file, read by
    many tasks, see ``json_array``) or ``"lines"`` (JSON lines).  ``task_id`` must be in
    the records: file position is not a stable key in Spark."""
    if layout == "array":
        return read_json_array(spark, path, TASK_DDL)
    if layout != "lines":
        raise ValueError(f"layout is 'array' or 'lines', not {layout!r}")
    return spark.read.schema(TASK_DDL).json(path)


def schema_tables(tasks: DataFrame) -> DataFrame:
    """(task_id, table_pos, table_name, table_comment)."""
    return tasks.select("task_id", F.posexplode("schema.schema_items").alias("table_pos", "t")).select(
        "task_id", "table_pos", "t.table_name", "t.table_comment")


def schema_columns(tasks: DataFrame) -> DataFrame:
    """(task_id, table_pos, table_name, col_pos, column_name, column_type,
    column_comment, column_content, is_pk, label)."""
    t = tasks.select("task_id", "column_labels",
                     F.posexplode("schema.schema_items").alias("table_pos", "t"))
    # parallel arrays; one that a record lacks counts as empty, its values are null
    part = lambda name, kind: F.coalesce(F.col(f"t.{name}"), F.array().cast(f"array<{kind}>"))
    z = t.select("task_id", "table_pos", F.col("t.table_name").alias("table_name"),
                 F.col("column_labels")[F.col("table_pos")].alias("labels"),
                 F.arrays_zip(part("column_names", "string").alias("column_name"),
                              part("column_types", "string").alias("column_type"),
                              part("column_comments", "string").alias("column_comment"),
                              part("column_contents", "array<string>").alias("column_content"),
                              part("pk_indicators", "int").alias("is_pk")).alias("z"))
    c = z.select("task_id", "table_pos", "table_name", "labels", F.posexplode("z").alias("col_pos", "c"))
    return c.select("task_id", "table_pos", "table_name", "col_pos", "c.column_name", "c.column_type",
                    "c.column_comment", "c.column_content", "c.is_pk",
                    F.col("labels")[F.col("col_pos")].alias("label"))


def foreign_keys(tasks: DataFrame) -> DataFrame:
    """(task_id, fk_pos, src_table, src_col, dst_table, dst_col)."""
    f = tasks.select("task_id", F.posexplode("schema.foreign_keys").alias("fk_pos", "fk"))
    return f.select("task_id", "fk_pos", F.col("fk")[0].alias("src_table"), F.col("fk")[1].alias("src_col"),
                    F.col("fk")[2].alias("dst_table"), F.col("fk")[3].alias("dst_col"))


def rebuild_schema(tables: DataFrame, columns: DataFrame, fks: DataFrame, table_order: str = "table_rank",
                   col_order: str = "col_rank") -> DataFrame:
    """A11 on the long tables: nested ``schema`` per task with tables in
    ``table_order`` and columns in ``col_order`` (ranks after pruning)."""
    cols = (columns.groupBy("task_id", "table_pos").agg(F.array_sort(F.collect_list(F.struct(
        F.col(col_order).alias("o"), "column_name", "column_type", "column_comment", "column_content",
        "is_pk"))).alias("c")))
    items = (tables.join(cols, ["task_id", "table_pos"], "left")
             .select("task_id", F.struct(
                 F.col(table_order).alias("o"), "table_name", "table_comment",
                 F.coalesce(F.transform("c", lambda x: x["column_name"]), F.array().cast("array<string>")).alias("column_names"),
                 F.coalesce(F.transform("c", lambda x: x["column_type"]), F.array().cast("array<string>")).alias("column_types"),
                 F.coalesce(F.transform("c", lambda x: x["column_comment"]), F.array().cast("array<string>")).alias("column_comments"),
                 F.coalesce(F.transform("c", lambda x: x["column_content"]), F.array().cast("array<array<string>>")).alias("column_contents"),
                 F.coalesce(F.transform("c", lambda x: x["is_pk"]), F.array().cast("array<int>")).alias("pk_indicators"))
                 .alias("item")))
    per_task = items.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list("item")), lambda x: x.dropFields("o")).alias("schema_items"))
    fk = (fks.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        "fk_pos", F.array("src_table", "src_col", "dst_table", "dst_col").alias("k")))).alias("f")))
    return (per_task.join(fk, "task_id", "left")
            .select("task_id", F.struct("schema_items",
                                        F.coalesce(F.transform("f", lambda x: x["k"]),
                                                   F.array().cast("array<array<string>>")).alias("foreign_keys"))
                    .alias("schema")))
