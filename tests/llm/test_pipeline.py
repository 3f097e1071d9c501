"""The pipeline against a plain recomputation of every stage in Python."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from codeweave.llm.bpe import load_ranks

from . import test_mixing, test_neardup, test_repetition

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_quality_keeps_what_the_rules_accept(stages):
    want = set()
    for r in stages[0]:
        n, _, _, _, repeats = test_repetition.brute(r.text)
        if n >= 10 and 100 * repeats <= 20 * n:
            want.add(r.doc_id)
    got = {r.doc_id for r in stages[1]}
    assert got <= want and len(want - got) <= len(want) // 100  # none but texts with a passage of over 200 words twice


def test_one_row_of_each_text_stays(stages):
    last = {}
    for r in stages[1]:
        text = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        last[text] = max(last.get(text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(last.values())


def test_one_row_of_each_component_stays(stages):
    want = [i for i, _, _, kept in test_neardup.brute([(r.doc_id, r.text) for r in stages[2]], 80) if kept]
    assert sorted(r.doc_id for r in stages[3]) == want


def test_mix_comes_near_its_targets(stages):
    sizes = defaultdict(int)
    for r in stages[3]:
        sizes[r.source] += len(r.text.split())
    want, taken, times = test_mixing.targets(sizes), defaultdict(int), Counter()
    for r in stages[4]:
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    biggest = max(len(r.text.split()) for r in stages[3])
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - t) <= 1.5 * biggest for s, t in want.items())
    assert sorted(set(stages[4])) == sorted({r for r in stages[3] if r.doc_id in times})


def test_ids_equal_the_library(stages):
    tokens = load_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(tokens)})
    ids = {r.doc_id: library.encode_ordinary(r.text) for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    assert all(r.ids == ids[r.doc_id] and r.round_trip for r in stages[5])


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect()
    assert Counter(got) == Counter((r.doc_id, r.n_tokens) for r in stages[5])


def test_nulls_empty_and_extra_columns(spark, docs):
    rows = [(1, None), (None, "some text " * 30), (2, ""), (3, " ".join(f"w{i}" for i in range(30)))]
    for data in (rows, []):
        df = docs(data)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL).collect()
            assert len(out) <= 3 * len(data)


def test_columns_of_any_name_pass_the_stages(spark):
    """Columns called like those that stages use inside come through unchanged."""
    names = ["_r", "_key", "_sha", "sha", "gone", "kept_key", "_mix", "_mix_size", "_t_target", "_j", "mix", "size", "hash", "copy", "rank", "in0", "In3", "measured"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i % 4}" if i % 4 else f"other {i} {text[::-1]}", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(tuple(r)[3:] == tuple(f"{n}{r.doc_id}" for n in names) for r in kept)
