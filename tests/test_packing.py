"""Corpus mixing, token totals, block packing, shards and batches."""

import random

from pyspark.sql import functions as F

from codeweave.operators.packing import (contiguous_shards, fixed_batches, mix_corpora, ordered_distinct,
                                         pack_blocks, token_totals, tokenize)
from codeweave.sources.blocks import read_token_blocks, write_token_blocks


def test_pack_golden(spark):
    df = spark.createDataFrame([(0, [1, 2, 0]), (1, [3, 0]), (2, [4, 5, 6, 0])], "row_id long, input_ids array<int>")
    df = df.withColumn("corpus_pos", F.lit(0)).withColumn("copy", F.lit(1)).withColumn("length", F.size("input_ids"))
    got = [r["input_ids"] for r in pack_blocks(df, 4).orderBy("block_id").collect()]
    assert got == [[1, 2, 0, 3], [0, 4, 5, 6]]


def test_pack_conserves_tokens_in_order(spark):
    rnd = random.Random(4)
    docs = [(i, [rnd.randint(3, 99) for _ in range(rnd.randint(0, 23))]) for i in range(300)]
    parts = []
    for pos, (name, w) in enumerate([("a", 2), ("b", 1)]):
        d = spark.createDataFrame([(i, ids + [2]) for i, ids in docs if (i % 2 == 0) == (name == "a")],
                                  "row_id long, input_ids array<int>")
        parts.append((name, d.withColumn("length", F.size("input_ids")), w))
    mixed = mix_corpora(parts)
    stream = []
    for name, w in [("a", 2), ("b", 1)]:
        for _ in range(w):
            for i, ids in docs:
                if (i % 2 == 0) == (name == "a"):
                    stream += ids + [2]
    blocks = pack_blocks(mixed, 16).orderBy("block_id").collect()
    assert [b["block_id"] for b in blocks] == list(range(len(stream) // 16))
    assert [t for b in blocks for t in b["input_ids"]] == stream[: (len(stream) // 16) * 16]


def test_tokenize_and_totals(spark):
    df = spark.createDataFrame([("a", 1, " Hello, world \n"), ("a", 2, "x"), ("b", 3, "")], "corpus string, row_id long, text string")
    tok = tokenize(df, "text")
    assert [r["length"] for r in tok.orderBy("row_id").collect()] == [4, 2, 1]
    tot = {r["corpus"]: (r["n_docs"], r["n_tokens"]) for r in token_totals(tok).collect()}
    assert tot == {"a": (2, 6), "b": (1, 1), None: (3, 7)}


def test_shards_like_ntile_and_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    shards = [r["shard"] for r in contiguous_shards(df, 4, ["k"]).orderBy("k").collect()]
    assert shards == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    b = fixed_batches(df, 3, ["k"], drop_last=True).orderBy("k").collect()
    assert [(r["k"], r["batch"]) for r in b] == [(i, i // 3) for i in range(9)]
    assert fixed_batches(df, 3, ["k"], drop_last=False).count() == 10


def test_ordered_distinct(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "x array<string>")
    assert df.select(ordered_distinct("x")).first()[0] == ["b", "a", "c"]


def test_blocks_roundtrip_and_range_check(spark, scratch):
    blocks = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7])], "block_id long, input_ids array<int>")
    write_token_blocks(blocks, f"{scratch}/b")
    back = read_token_blocks(spark, f"{scratch}/b", block_size=3).orderBy("block_id").collect()
    assert [r["labels"] for r in back] == [[1, 2, 3], [4, 5, 6]]
    assert back[0]["attention_mask"] == [1, 1, 1]
    bad = spark.createDataFrame([(0, [70000])], "block_id long, input_ids array<int>")
    try:
        write_token_blocks(bad, f"{scratch}/bad")
        raised = False
    except Exception:
        raised = True
    assert raised


def test_frequency_vocab_and_tokenize(spark):
    from codeweave.operators.packing import frequency_vocab, tokenize_with_vocab
    df = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, ""), (4, None)], "k long, text string")
    vocab = frequency_vocab(df)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"a": 3, "b": 4, "c": 5}
    got = {r["k"]: r["input_ids"] for r in tokenize_with_vocab(df, "k", vocab.where("token <> 'c'")).collect()}
    assert got == {1: [3, 4, 3, 0, 2], 2: [4, 3, 2], 3: [2], 4: [2]}


def test_row_ids_above_1e12_keep_their_copies_apart(spark):
    df = spark.createDataFrame([(0, [1]), (2 * 10 ** 12, [2])], "row_id long, input_ids array<int>").withColumn("length", F.size("input_ids"))
    blocks = pack_blocks(mix_corpora([("a", df, 2)]), 4).collect()
    assert [b["input_ids"] for b in blocks] == [[1, 2, 1, 2]]


def test_null_and_nan_order_keys_are_kept(spark):
    from codeweave.operators.prefix import exclusive_prefix_sums
    rows = [(float(i), 1) for i in range(1000)] + [(None, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "x double, v int").repartition(5)
    got = {str(r["x"]): r["v_before"] for r in exclusive_prefix_sums(df, ["x"], ["v"]).collect()}
    assert len(got) == 1002 and got["None"] == 0 and got["0.0"] == 1 and got["nan"] == 1001
    ids = spark.createDataFrame([(None,), *[(i,) for i in range(1000)]], "k long")
    assert fixed_batches(ids, 1, ["k"]).count() == 1001


def test_order_by_strings_and_several_columns(spark):
    from codeweave.operators.prefix import exclusive_prefix_sums
    rows = [("b", 2, 5), ("a", 9, 1), ("b", 1, 7), (None, 3, 2)]
    got = {(r["s"], r["n"]): r["v_before"] for r in exclusive_prefix_sums(spark.createDataFrame(rows, "s string, n int, v long"), ["s", "n"], ["v"]).collect()}
    assert got == {(None, 3): 0, ("a", 9): 2, ("b", 1): 3, ("b", 2): 10}


def test_tokens_are_looked_up_by_batches(spark):
    """Texts travel as codes of their batch's distinct tokens, not token by token; texts
    of one key are merged by position, a null key finds nothing."""
    from codeweave.operators.packing import tokenize_with_vocab
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "x a"), (None, "a"), (5, "a"), (5, "b b")]
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id int")
    out = tokenize_with_vocab(spark.createDataFrame(rows, "k long, text string").repartition(3), "k", vocab)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r["k"], r["input_ids"], r["length"]) for r in out.collect()), key=str)
    assert got == sorted([(1, [8, 7, 8, 2], 4), (2, [2], 1), (3, [2], 1), (4, [0, 7, 2], 3), (None, [2], 1),
                          (5, [7, 8, 8, 2], 4), (5, [7, 8, 8, 2], 4)], key=str)
