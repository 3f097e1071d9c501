"""End-to-end flows on a two-task fixture."""

import copy
import json

from pyspark.sql import functions as F

from codeweave.plans.text_to_code import (evaluation, few_shot_inputs, pretraining_blocks, pruned_schemas,
                                          pruner_evaluation, training_examples, training_schemas, zero_shot_inputs)
from codeweave.sources.tasks import read_tasks, schema_columns, schema_tables

from .test_prompts import TASK


def _fixture(spark, scratch):
    t2 = copy.deepcopy(TASK)
    t2["task_id"] = 1
    t2["text"] = "Write an Oracle procedure that deletes loans of a branch."
    t2["plsql"] = 'CREATE OR REPLACE PROCEDURE sp(para_b NUMBER) IS BEGIN DELETE FROM "loan" WHERE "branch_ID" = para_b; END;'
    t2["update"], t2["delete"] = 0, 1
    path = f"{scratch}/tasks.json"
    with open(path, "w") as f:
        json.dump([TASK, t2], f)
    tasks = read_tasks(spark, path).withColumn("predict_skeleton", F.col("skeleton"))
    ts = schema_tables(tasks).select("task_id", "table_pos", (F.lit(1.0) / (F.col("table_pos") + 1)).alias("prob"))
    cs = schema_columns(tasks).select("task_id", "table_pos", "col_pos", (F.col("col_pos") * 0.1).alias("prob"))
    return tasks, ts, cs


def test_few_and_zero_shot_inputs(spark, scratch):
    tasks, ts, cs = _fixture(spark, scratch)
    lexicon = spark.createDataFrame([("city", "NN"), ("bank", "NN"), ("loans", "NNS")], "word string, tag string")
    rows = few_shot_inputs(tasks, tasks, ts, cs, k_tables=1, k_columns=2, k_demos=2, lexicon=lexicon, max_prefix=40).collect()
    assert all(len(r["input_ids"]) == 40 and r["input_ids"][0] == 1 and r["attention_mask"] == [1] * 40 for r in rows)
    texts = few_shot_inputs(tasks, tasks, ts, cs, k_demos=1, lexicon=lexicon, mode="texts").collect()
    assert {r["eval_id"]: r["prompt"].count(r["text"]) for r in texts} == {0: 2, 1: 2}  # its own demo is the nearest
    few = {r["eval_id"]: r["prompt"] for r in rows}
    assert set(few) == {0, 1}
    assert "table bank , columns = [ state ( VARCHAR2 ) , city ( VARCHAR2 | comment : city name | values : Albany ) ]" in few[0]
    assert "foreign keys : None" in few[0] and "Skeleton: " in few[0]
    zero = zero_shot_inputs(tasks, ts, cs, max_prefix=16).collect()
    assert all(r["input_ids"][0] == 1 and len(r["input_ids"]) == 16 for r in zero)


def test_evaluation_report(spark, scratch):
    tasks, _, _ = _fixture(spark, scratch)
    cands = spark.createDataFrame([
        (0, 0, "CREATE OR REPLACE PROCEDURE x(p VARCHAR2, q VARCHAR2) IS BEGIN UPDATE bank SET city = q WHERE state = p; END;", None),
        (1, 0, "garbage", "ORA-00900"), (1, 1, "", "ORA-1")], "task_id long, cand_pos int, code string, error string")
    execution = spark.createDataFrame([(0, True), (1, False)], "task_id long, same boolean")
    r = evaluation(tasks, cands, execution).first()
    assert (r["n"], r["accurate"], r["exact"], r["no_error"]) == (2, 1, 1, 1)
    assert r["update_acc"] == 1.0 and r["delete_acc"] == 0.0


def test_pretraining_blocks_and_pruner(spark):
    a = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)], "row_id long, text string")
    blocks = pretraining_blocks([("a", a, 2), ("b", a, 1)], block_size=8).collect()
    assert blocks and all(len(b["input_ids"]) == 8 for b in blocks)
    items = spark.createDataFrame([(1, 0, -1, 0.9, 1), (1, 1, -1, 0.1, 0), (1, 0, 0, 0.8, 1), (1, 0, 1, 0.3, 0)],
                                  "task_id long, table_pos int, col_pos int, prob double, label int")
    rep = pruner_evaluation(items, max_k=3)
    assert rep["table_auc"].first()["auc"] == 1.0
    assert [r["covered"] for r in rep["column_coverage"].orderBy("k").collect()] == [1, 1, 1]


def test_few_shot_with_caller_vectors(spark, scratch):
    tasks, ts, cs = _fixture(spark, scratch)
    vec = F.when(F.col("task_id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    t2 = tasks.withColumn("qv", vec)
    few = few_shot_inputs(t2, t2, ts, cs, k_demos=1, question_vec="qv", w=1.0).collect()
    # with w = 1 only the caller's vectors count: each task's best demo is itself
    by = {r["eval_id"]: r["prompt"] for r in few}
    assert by[0].count("sets the city") >= 2 and by[1].count("deletes loans") >= 2


def test_matched_contents_follow_their_columns(spark, scratch):
    tasks, ts, cs = _fixture(spark, scratch)
    got = {r["task_id"]: r["matched_contents"] for r in pruned_schemas(tasks, ts, cs, 1, 2).collect()}
    assert got[0] == {"bank.state": ["NY"]}
    got = {r["task_id"]: r["matched_contents"] for r in pruned_schemas(tasks, ts, cs, 1, 1).collect()}
    assert set(got[0]) <= {"bank.state"}


def test_training_examples(spark, scratch):
    tasks, _, _ = _fixture(spark, scratch)
    for r in training_schemas(tasks, 1, 1).collect():
        items = {t["table_name"]: t["column_names"] for t in r["schema"]["schema_items"]}
        assert set(items) == {"bank"} and {"city", "state"} <= set(items["bank"])  # labelled ones stay, even above k
    for r in training_examples(tasks, max_tokens=300).collect():
        e = r["example"]
        assert len(e["input_ids"]) == len(e["labels"]) == len(e["attention_mask"]) == 300
        assert any(x != -100 for x in e["labels"])
