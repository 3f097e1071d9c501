"""Plug points (F1 tokenizer, F3 scorer), corpus source, alignment and
hot-key inputs (one key holding a third of the rows)."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeweave.operators.candidates import align, first_valid_candidate
from codeweave.operators.metrics import coverage_at_k
from codeweave.operators.packing import pack_blocks, pretrained_tokenizer, tokenize
from codeweave.operators.schema_items import score_schema_items, topk_per_group
from codeweave.sources.corpus import read_corpus


def test_read_corpus_kinds_and_strip(spark, scratch):
    rows = {"plsql": [{"plsql": "  BEGIN NULL; END;\n"}],
            "sql": [{"sql": "\tSELECT 1 "}],
            "text2text": [{"input_text": " q ", "output_text": "a \n"}],
            "text2code": [{"text": "t", "code": " c"}]}
    got = {}
    for kind, recs in rows.items():
        path = f"{scratch}/{kind}.jsonl"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in recs))
        got[kind] = read_corpus(spark, path, kind).first()["text"]
    assert got == {"plsql": "BEGIN NULL; END;", "sql": "SELECT 1", "text2text": "q \na", "text2code": "t\n c"}


def test_pretrained_tokenizer_plug(spark, scratch):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace
    tk = Tokenizer(WordLevel({"[UNK]": 0, "select": 5, "from": 6, "t": 7}, unk_token="[UNK]"))
    tk.pre_tokenizer = Whitespace()
    path = f"{scratch}/tok.json"
    tk.save(path)
    df = spark.createDataFrame([("select x from t",)], "text string")
    ids = tokenize(df, "text", pretrained_tokenizer(path), eos_id=2).first()["input_ids"]
    assert ids == [5, 0, 6, 7, 2]


def test_model_scorer_plug(spark):
    items = spark.createDataFrame([(1, 0, 0, 0, "city"), (1, 0, 0, 1, "zip code")],
                                  "task_id long, chunk_pos int, table_pos int, col_pos int, name string")
    texts = spark.createDataFrame([(1, "Which city?")], "task_id long, text string")
    default = {r["col_pos"]: r["prob"] for r in score_schema_items(items, texts).collect()}
    assert default == {0: 1.0, 1: 0.0}

    def length_scorer(batches):
        for pdf in batches:
            yield pd.DataFrame({"task_id": pdf["task_id"], "col_pos": pdf["col_pos"],
                                "prob": pdf["name"].str.len() / 10.0})
    custom = score_schema_items(items, texts, scorer=length_scorer,
                                out_schema="task_id long, col_pos int, prob double")
    assert {r["col_pos"]: r["prob"] for r in custom.collect()} == {0: 0.4, 1: 0.8}


def test_align(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "task_id long, a string")
    b = spark.createDataFrame([(2, "q"), (1, "p")], "task_id long, b string")
    assert sorted(map(tuple, align(a, b).collect())) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(ValueError):
        align(a, b.where("task_id = 1"))


def test_hot_key_inputs(spark):
    # one task holds a third of all rows
    rows = [(0, i, float(i % 97), i % 5 == 0) for i in range(3000)] + \
           [(g, i, float((g * i) % 13), i == 1) for g in range(1, 1001) for i in range(6)]
    df = spark.createDataFrame(rows, "g long, p long, s double, y boolean")
    cov = {r["k"]: r["covered"] for r in coverage_at_k(df, group=["g"], score="s", pos="p", label="y",
                                                          max_k=3000, only_with_positives=True).collect()}
    assert cov[3000] == 1001 and cov[1] < 1001
    top = topk_per_group(df, ["g"], "s", "p", 3)
    assert top.where("g = 0").count() == 3 and top.count() == 3 * 1001
    cands = df.select(F.col("g").alias("task_id"), F.col("p").alias("cand_pos"),
                      F.col("s").cast("string").alias("code"),
                      F.when(~F.col("y"), F.lit("err")).alias("error"))
    chosen = {r["task_id"]: r["chosen_pos"] for r in first_valid_candidate(cands).collect()}
    assert chosen[0] == 0 and chosen[5] == 1
    docs = spark.createDataFrame([(0, list(range(3, 3003)))] + [(i, [1, 2]) for i in range(1, 1500)],
                                 "row_id long, input_ids array<int>")
    docs = docs.withColumn("corpus_pos", F.lit(0)).withColumn("copy", F.lit(1)).withColumn("length", F.size("input_ids"))
    blocks = pack_blocks(docs, 100).orderBy("block_id").collect()
    stream = list(range(3, 3003)) + [1, 2] * 1499
    assert [t for b in blocks for t in b["input_ids"]] == stream[: len(stream) // 100 * 100]
