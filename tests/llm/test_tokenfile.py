import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeweave.llm import tokenfile
from codeweave.llm.frames import shared_folder
from codeweave.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [None, "", "  \n\t ", "It's THE été ẛ̣ İΣσΣ x", "<|endoftext|> a<|startoftext|>b 'll don 't", "\x1c\x85a\xa0b　c d",
         "\U0001F600 12345 !!! ...", "word " * 30000, "ab" * 20000, "̈ a ̈", "naïve café\x0bq\x0cr\rs"]


def brute(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_grammar_round_trip_and_random_access():
    rnd = random.Random(1)
    cases = [[], [5], [7] * 1000, [1, 2] * 500 + [1], [rnd.randrange(4) for _ in range(5000)], [rnd.randrange(70000) for _ in range(300)]]
    for ids in cases:
        ids = np.array(ids, np.int64)
        g = tokenfile.re_pair(ids, min_count=2)
        assert (g.expand(g.sequence) == ids).all()
        assert g.sizes(g.sequence).sum() == len(ids)
        for _ in range(50):
            a = rnd.randrange(len(ids) + 1)
            n = rnd.randrange(len(ids) - a + 1)
            assert (g.read(a, n) == ids[a:a + n]).all()
    assert len(tokenfile.re_pair(np.array([1, 2, 3, 4] * 1000), min_count=2).sequence) < 20


def most_places(sequence):
    """Places without overlap of the most frequent pair."""
    count, last = Counter(), {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair, -2) < i - 1:
            count[pair] += 1
            last[pair] = i
    return max(count.values(), default=0)


def test_rounds_end_when_no_pair_is_frequent():
    rnd = random.Random(2)
    for k in (2, 3, 5, 40, 300):
        for n in (2, 3, 16):
            ids = np.array([rnd.randrange(k) for _ in range(3000)] + [1] * 99 + list(range(200)) * 9, np.int64)
            g = tokenfile.re_pair(ids, min_count=n)
            assert (g.expand(g.sequence) == ids).all()
            assert most_places(g.sequence.tolist()) < n
    deep = np.array([7] * (1 << 18), np.int64)  # more rounds than 12
    assert most_places(tokenfile.re_pair(deep, min_count=2).sequence.tolist()) < 2


def test_twenty_copies_in_a_block_are_compressed():
    rng = np.random.default_rng(4)
    passages = rng.integers(0, 49_000, (50, 600))
    ids = np.concatenate([rng.integers(0, 49_000, 300_000), np.tile(passages, (20, 1))[rng.permutation(1000)].ravel()])
    assert tokenfile.BLOCK_TOKENS >= len(ids)
    g = tokenfile.re_pair(ids)
    assert (g.expand(g.sequence) == ids).all()
    assert len(g.sequence) < 310_000


def test_written_files_equal_the_library(spark, docs):
    rows = [(len(TEXTS) - i, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (3, "again"), (3, "again")]
    path = shared_folder(spark, "tokens")
    tokenfile.write_tokens(docs(rows).repartition(3), path, PATH, 1)
    got = tokenfile.read_tokens(spark.read.parquet(path)).withColumn("crc", tokenfile.ids_crc32(F.col("ids"))).collect()
    assert sorted(((r.key, r.start, len(r.ids), r.crc) for r in got), key=lambda r: r[1]) == brute(rows)


def test_blocks_of_few_tokens(spark):
    rows = [(i, list(range(i % 7)) * 3) for i in range(100)]
    ids = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    path = shared_folder(spark, "tokens")
    tokenfile.to_blocks(ids, block_tokens=20).write.parquet(path)
    got = sorted(tokenfile.read_tokens(spark.read.parquet(path)).collect(), key=lambda r: r.key)
    at = 0
    for (i, want), r in zip(rows, got):
        assert (r.key, r.ids, r.start) == (i, want, at)
        at += len(want)
    assert spark.read.parquet(path).count() > 10


def test_texts_become_blocks_in_one_worker(spark, docs):
    rows = [(i, f"word{i % 7} " * i) for i in range(60)]
    blocks = tokenfile.text_blocks(docs(rows), PATH, 1, block_tokens=100)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    apart = (docs(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
             .select("doc_id", F.concat(tokenfile.encode_words(F.col("text"), PATH), F.array(F.lit(1))).alias("ids")))
    assert sorted(blocks.collect()) == sorted(tokenfile.to_blocks(apart, block_tokens=100).collect())


def test_empty_table(spark, docs):
    path = shared_folder(spark, "tokens")
    tokenfile.write_tokens(docs([]), path, PATH, 1)
    assert tokenfile.read_tokens(spark.read.schema(tokenfile.BLOCK).parquet(path)).collect() == []


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query_over_all_documents(spark, d):
    got = [tuple(r) for r in QUERIES["op2_token_grammar"][0](spark, d).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_each_word_is_looked_up_once_for_a_batch(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_ENTRIES", 0)
    with open(PATH, encoding="utf-8") as f:
        encoder = tokenfile.WordEncoder(f.read())
    asked = []
    encoder.known.encode = lambda words: asked.extend(words) or encoder._new(words)
    texts = ["Naïve café, x1 don't qzxjk. " * 50, None, "", "café, café qzxjk. É\x1cb"] * 5
    ids, bounds = encoder(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) == 7


def test_later_rounds_look_at_few_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 49_000, 512)
    ids = np.concatenate([rng.integers(0, 49_000, 200_000), np.tile(passage, 20)])
    seen = []
    monkeypatch.setattr(tokenfile, "_mixed", lambda codes, own=tokenfile._mixed: seen.append(len(codes)) or own(codes))
    g = tokenfile.re_pair(ids)
    assert (g.expand(g.sequence) == ids).all() and len(g.sequence) < 201_000
    assert len(seen) > 5 and max(seen[1:]) < 50_000


def test_the_query_reads_and_digests_in_one_worker(spark, docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_token_grammar"][0](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)
