"""Schema text, prompts and training examples against FIXTURES goldens."""

import json

from pyspark.sql import functions as F

from codeweave.functions.text import COT_ORACLE, COT_POSTGRES, INSTRUCTION_LINE, cot_hint
from codeweave.operators.prompts import few_shot_prompts, schema_sequence, sft_example, truncate_left, zero_shot_prompt
from codeweave.sources.tasks import read_tasks

TASK = {"task_id": 0, "text": "Write an Oracle procedure that sets the city of every bank in a state.",
        "concise_text": "Set bank city by state.",
        "detailed_text": "Write an Oracle procedure that sets the city of every bank in a state.",
        "plsql": "CREATE OR REPLACE PROCEDURE sp(para_state VARCHAR2, para_city VARCHAR2) IS BEGIN UPDATE \"bank\" "
                 "SET \"city\" = para_city WHERE \"state\" = para_state; END;",
        "call": ["BEGIN sp('NY','Albany'); commit; END;"], "database": "loan_1", "table": ["bank"],
        "schema": {"schema_items": [
            {"table_name": "bank", "table_comment": "", "column_names": ["branch_ID", "city", "state"],
             "column_types": ["NUMBER", "VARCHAR2", "VARCHAR2"], "column_comments": ["", "city name", ""],
             "column_contents": [["1", "2"], ["Albany"], []], "pk_indicators": [1, 0, 0]},
            {"table_name": "loan", "table_comment": "loans", "column_names": ["loan_ID", "branch_ID"],
             "column_types": ["NUMBER", "NUMBER"], "column_comments": ["", ""], "column_contents": [[], []],
             "pk_indicators": [1, 0]}],
            "foreign_keys": [["loan", "branch_ID", "bank", "branch_ID"]]},
        "skeleton": "CREATE OR REPLACE PROCEDURE sp(_) IS BEGIN UPDATE _ SET _ = _ WHERE _ = _; END;",
        "table_num": 1, "parameter": 2, "insert": 0, "select": 0, "update": 1, "delete": 0, "if": 0, "loop": 0,
        "declare": 0, "table_labels": [1, 0], "column_labels": [[0, 1, 1], [0, 0]],
        "matched_contents": {"bank.state": ["NY"], "loan.loan_ID": ["7"]}}

GOLDEN = (
    "database schema :\n"
    "table bank , columns = [ branch_ID ( NUMBER | primary key | values : 1 , 2 ) , city ( VARCHAR2 | comment : "
    "city name | values : Albany ) , state ( VARCHAR2 ) ]\n"
    "table loan , columns = [ loan_ID ( NUMBER | primary key ) , branch_ID ( NUMBER ) ]\n"
    "foreign keys :\n"
    "loan.branch_ID = bank.branch_ID")


def _tasks(spark, scratch):
    path = f"{scratch}/tasks.json"
    with open(path, "w") as f:
        json.dump([TASK], f)
    return read_tasks(spark, path)


def test_read_tasks_declared_schema(spark, scratch):
    df = _tasks(spark, scratch)
    assert dict(df.dtypes)["matched_contents"] == "map<string,array<string>>"
    assert df.count() == 1


def test_schema_sequence_golden(spark, scratch):
    df = _tasks(spark, scratch)
    got = df.select(schema_sequence("schema").alias("s")).first()["s"]
    assert got == GOLDEN


def test_schema_sequence_after_pruning(spark, scratch):
    df = _tasks(spark, scratch)
    kept = df.select(F.struct(F.slice("schema.schema_items", 1, 1).alias("schema_items"),
                              F.filter("schema.foreign_keys", lambda k: F.lit(False)).alias("foreign_keys")).alias("s"))
    got = kept.select(schema_sequence("s").alias("t")).first()["t"]
    assert got.endswith("foreign keys : None")
    assert "table loan" not in got


def test_cot_hint(spark):
    df = spark.createDataFrame([("an ORACLE task",), ("a postgres task",)], "t string")
    got = [r[0] for r in df.select(cot_hint("t")).collect()]
    assert got == [COT_ORACLE, COT_POSTGRES]


def test_zero_shot_prompt_layout(spark):
    df = spark.createDataFrame([("q", "S", "sk")], "t string, s string, k string")
    got = df.select(zero_shot_prompt("t", "s", skeleton="k", cot=False)).first()[0]
    assert got == "S\nSkeleton: sk\nq\n" + INSTRUCTION_LINE + "\n"


def test_few_shot_prompt_order(spark):
    tasks = spark.createDataFrame([(1, "Q", "S")], "eval_id long, text string, schema_sequence string")
    topk = spark.createDataFrame([(1, 2, 20), (1, 1, 10)], "eval_id long, rank int, demo_id long")
    demos = spark.createDataFrame([(10, "t10", "c10"), (20, "t20", "c20")], "demo_id long, text string, plsql string")
    got = few_shot_prompts(tasks, topk, demos).first()["prompt"]
    assert got == "t10\nc10\n\nt20\nc20\n\nS\nQ\n"


def test_sft_example_goldens(spark):
    df = spark.createDataFrame([([11, 12], [21])], "p array<int>, t array<int>")
    fit = df.select(sft_example("p", "t", 6, bos=1, eos=2, pad=0).alias("e")).first()["e"]
    assert fit["input_ids"] == [1, 11, 12, 21, 2, 0]
    assert fit["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert fit["labels"] == [-100, -100, -100, 21, 2, -100]
    cut = df.select(sft_example("p", "t", 4, bos=1, eos=2, pad=0).alias("e")).first()["e"]
    assert cut["input_ids"] == [1, 12, 21, 2]
    assert cut["attention_mask"] == [1, 1, 1, 1]
    assert cut["labels"] == [-100, -100, 21, 2]


def test_truncate_left(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 9],)], "ids array<int>")
    assert df.select(truncate_left("ids", 3, bos=[1])).first()[0] == [1, 8, 9]
    assert df.select(truncate_left("ids", 9, bos=[1])).first()[0] == [5, 6, 7, 8, 9]
    assert df.select(truncate_left("ids", 4, bos=[64790, 64792], always_bos=True)).first()[0] == [64790, 64792, 8, 9]
