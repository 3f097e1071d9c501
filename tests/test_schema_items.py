"""Pruning, chunking, chunk-score merge and name/token alignment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codeweave.operators.schema_items import (budget_chunks, decorate_name, filter_foreign_keys,
                                              filter_matched_map, label_topup_sample, merge_chunk_scores,
                                              name_token_spans, prune_eval, realign_counts, regroup)


def _pieces(s):
    return sum(math.ceil(len(w) / 4) for w in s.split())


def _chunks_by_loop(text, tables, budget):
    """tables: list of (name, [column names]); greedy over (table, column)."""
    def length(items):
        n = 2 + _pieces(text)
        seen = []
        for t, c in items:
            if t not in [x[0] for x in seen]:
                seen.append((t, []))
            [x for x in seen if x[0] == t][0][1].append(c)
        for t, cols in seen:
            n += 1 + _pieces(t) + 1 + sum(_pieces(c) for c in cols) + len(cols) - 1
        return n
    chunks, cur = [], []
    for t, cols in tables:
        for c in cols:
            if length(cur + [(t, c)]) < budget:
                cur.append((t, c))
            else:
                chunks.append(cur)
                cur = [(t, c)]
    chunks.append(cur)
    return [c for c in chunks if c]


@pytest.mark.parametrize("long_task", [10_000, 4])
def test_budget_chunks_brute_force(spark, monkeypatch, long_task):
    from codeweave.operators import schema_items
    monkeypatch.setattr(schema_items, "LONG_TASK", long_task)  # 4: most tasks are cut by doubling
    monkeypatch.setattr(schema_items, "BAND", 1)
    rnd = random.Random(9)
    items, texts, want = [], [], {}
    for task in range(40):
        text = " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 6)))
        tables = [(f"t{task}_{i}" + "x" * rnd.randint(0, 9), [f"c{j}" + "y" * rnd.randint(0, 12)
                                                              for j in range(rnd.randint(0, 5))])
                  for i in range(rnd.randint(1, 5))]
        texts.append((task, text))
        for tp, (t, cols) in enumerate(tables):
            for cp, c in enumerate(cols):
                items.append((task, tp, cp, t, c))
        pos = {(t, c): (tp, cp) for tp, (t, cols) in enumerate(tables) for cp, c in enumerate(cols)}
        for k, chunk in enumerate(_chunks_by_loop(text, tables, 25)):
            for t, c in chunk:
                want[(task,) + pos[(t, c)]] = k
    df = spark.createDataFrame(items, "task_id long, table_pos int, col_pos int, table_name string, column_name string")
    tx = spark.createDataFrame(texts, "task_id long, text string")
    got = {(r["task_id"], r["table_pos"], r["col_pos"]): r["chunk_pos"] for r in budget_chunks(df, tx, budget=25).collect()}
    assert got == want


def test_a_long_task_is_spread_and_equals_the_loop(spark, monkeypatch):
    from codeweave.operators import prefix, schema_items
    rows = spark.range(20_000).select(F.lit(7).alias("task_id"), (F.col("id") / 50).cast("int").alias("table_pos"), (F.col("id") % 50).cast("int").alias("col_pos"),
                                      F.concat(F.lit("t"), (F.col("id") / 50).cast("int")).alias("table_name"),
                                      F.repeat(F.lit("c"), (F.col("id") % 23 + 1).cast("int")).alias("column_name"))
    texts = spark.createDataFrame([(7, "some words")], "task_id int, text string")
    ranges, dealt = [], prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda *a: (ranges.append(out := dealt(*a)), out)[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = schema_items.budget_chunks(rows, texts, budget=100).collect()
        most = max(r["count"] for r in ranges[0].groupBy("_range").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, pos, used, last = {}, -1, 0, None
    for i in range(20_000):
        t, size = i // 50, math.ceil((i % 23 + 1) / 4)
        fresh = math.ceil(len(f"t{t}") / 4) + 2 + size
        add = size + 1 if last == t else fresh
        if pos >= 0 and used + add < 100:
            used += add
        else:
            pos, used = pos + 1, 2 + 3 + fresh
        last = t
        want[t, i % 50] = pos
    assert {(r.table_pos, r.col_pos): r.chunk_pos for r in spread} == want and most < 10_000


def test_merge_chunk_scores_cases(spark):
    tables = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "task_id long, table_pos int")
    ct = spark.createDataFrame([(1, 0, 0, 0.3), (1, 1, 0, 0.7), (1, 1, 1, 0.5)],
                               "task_id long, chunk_pos int, table_pos int, prob double")
    cc = spark.createDataFrame([(1, 0, 0, 0, 0.1), (1, 0, 0, 1, 0.2), (1, 1, 0, 2, 0.3), (1, 1, 1, 0, 0.9)],
                               "task_id long, chunk_pos int, table_pos int, col_pos int, prob double")
    got = {r["table_pos"]: (r["table_prob"], r["column_probs"]) for r in merge_chunk_scores(tables, ct, cc).collect()}
    assert got == {0: (0.7, [0.1, 0.2, 0.3]), 1: (0.5, [0.9]), 2: (0.0, [])}


def test_prune_eval_ties_and_regroup(spark):
    ts = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.9), (1, 3, None)], "task_id long, table_pos int, prob double")
    cs = spark.createDataFrame([(1, 0, 0, 0.2), (1, 0, 1, 0.2), (1, 0, 2, 0.8), (1, 2, 0, 0.1), (1, 1, 0, 0.3)],
                               "task_id long, table_pos int, col_pos int, prob double")
    tables, cols = prune_eval(ts, cs, 2, 2)
    assert [r["table_pos"] for r in tables.orderBy("table_rank").collect()] == [2, 0]
    rg = {r["table_pos"]: [x["col_pos"] for x in r["c"]]
          for r in regroup(cols, ["task_id", "table_pos"], "col_rank", ["col_pos"], "c").collect()}
    assert rg == {0: [2, 0], 2: [0]}


def test_label_topup_keeps_all_positives(spark):
    rows = [(g, i, 1 if (g + i) % 3 == 0 else 0) for g in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "g long, i long, y int")
    out = label_topup_sample(df, ["g"], "i", "y", 3).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append(r)
    for g, rs in by.items():
        pos = [i for gg, i, y in rows if gg == g and y == 1]
        assert set(pos) <= {r["i"] for r in rs}
        assert len(rs) == max(len(pos), 3)
        assert sorted(r["order"] for r in rs) == list(range(1, len(rs) + 1))
    again = label_topup_sample(df, ["g"], "i", "y", 3).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))  # seeded, reproducible


def test_foreign_keys_and_matched_map(spark):
    fks = spark.createDataFrame([(1, "a", "x", "b", "y"), (1, "a", "x", "c", "y"), (2, "a", "x", "b", "y")],
                                "task_id long, src_table string, src_col string, dst_table string, dst_col string")
    kept = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "task_id long, table_name string")
    got = [(r["task_id"], r["dst_table"]) for r in filter_foreign_keys(fks, kept).collect()]
    assert got == [(1, "b")]
    m = spark.createDataFrame([({"bank.state": ["NY"], "loan.loan_ID": ["7"]}, ["bank.state", "bank.city"])],
                              "m map<string,array<string>>, k array<string>")
    assert m.select(filter_matched_map("m", "k")).first()[0] == {"bank.state": ["NY"]}


def test_decorate_name(spark):
    df = spark.createDataFrame([("t", "c"), ("t", "")], "n string, c string")
    assert [r[0] for r in df.select(decorate_name("n", "c")).collect()] == ["t ( c ) ", "t"]


def test_name_token_spans_brute_force(spark):
    text = "find items"
    tables = [("orders", ["id", "price_total"]), ("empty", []), ("lines", ["a", "bbbbbbbbb"])]
    words = [text]
    names = {}
    for tp, (t, cols) in enumerate(tables):
        words += ["|", t]
        names[(tp, -1)] = len(words) - 1
        words.append(":")
        for cp, c in enumerate(cols):
            words.append(c)
            names[(tp, cp)] = len(words) - 1
            words.append(",")
        words = words[:-1]
    token_word = [None]  # leading special token
    for wi, w in enumerate(words):
        token_word += [wi] * _pieces(w)
    token_word = token_word[:11]  # max_length 12: positions 0..10 before the closing special
    want = {}
    for key, wi in names.items():
        pos = [p for p, x in enumerate(token_word) if x == wi]
        if pos:
            want[key] = (pos[0], len(pos))
    tx = spark.createDataFrame([(1, text)], "task_id long, text string")
    tb = spark.createDataFrame([(1, tp, t) for tp, (t, _) in enumerate(tables)], "task_id long, table_pos long, table_name string")
    co = spark.createDataFrame([(1, tp, cp, c) for tp, (_, cols) in enumerate(tables) for cp, c in enumerate(cols)],
                               "task_id long, table_pos long, col_pos long, column_name string")
    spans = name_token_spans(tx, tb, co, max_length=12)
    got = {(r["table_pos"], r["col_pos"]): (r["first_token"], r["n_tokens"]) for r in spans.collect()}
    assert got == want
    counts = {r["table_pos"]: r["n_columns"] for r in realign_counts(spans).collect()}
    assert counts == {t: sum(1 for (tt, c) in want if tt == t and c >= 0) for t in {t for t, c in want if c >= 0}}


def test_spans_of_table_positions_above_1e6(spark):
    from codeweave.operators.schema_items import name_token_spans
    texts = spark.createDataFrame([(1, "ab cd"), (2, "ef")], "task_id long, text string")
    tables = spark.createDataFrame([(1, 999_999, "t1"), (1, 1_000_003, "t2"), (2, 0, "u1"), (2, 5_000_000, "u2")],
                                   "task_id long, table_pos long, table_name string")
    columns = spark.createDataFrame([(1, 999_999, 0, "c"), (1, 1_000_003, 0, "d"), (2, 0, 0, "e"), (2, 5_000_000, 0, "f")],
                                    "task_id long, table_pos long, col_pos long, column_name string")
    got = {(r["task_id"], r["table_pos"], r["col_pos"]): r["first_token"] for r in name_token_spans(texts, tables, columns).collect()}
    # [special] ab cd | t1 : c | t2 : d   and   [special] ef | u1 : e | u2 : f
    assert got == {(1, 999_999, -1): 4, (1, 999_999, 0): 6, (1, 1_000_003, -1): 8, (1, 1_000_003, 0): 10,
                   (2, 0, -1): 3, (2, 0, 0): 5, (2, 5_000_000, -1): 7, (2, 5_000_000, 0): 9}
