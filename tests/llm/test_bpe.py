import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave.llm import bpe, frames
from codeweave.llm.registry import QUERIES
from codeweave.llm.vocabulary import byte_strings
from codeweave.llm.words import PIECE_BYTES

TOKENS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(TOKENS)})
ENCODER = bpe.Encoder(bpe.model_proto(TOKENS), public_tokenizers.PATTERN)


def unpacked(run):
    return np.frombuffer(run, np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtre19é日ABCabc_=-")), max_size=200))
def test_encoder_equals_rank_merging(text):
    assert unpacked(ENCODER([text])[0]) == REFERENCE.encode_ordinary(text)


def test_every_token_and_a_full_cache(monkeypatch):
    for i, t in enumerate(TOKENS):
        try:
            text = t.decode()
        except UnicodeDecodeError:
            continue
        assert unpacked(ENCODER([text])[0]) == REFERENCE.encode_ordinary(text), i
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    small = bpe.Encoder(bpe.model_proto(TOKENS), public_tokenizers.PATTERN)
    for text in ("a bc def ghi jkl mno", "a bc def", "zz a qq bc zz", "jkl mno pqr a"):
        assert unpacked(small([text])[0]) == REFERENCE.encode_ordinary(text)


def test_columns_round_trip(spark, docs):
    texts = [None, "", "  two  blanks\n\n \n x", "<|endoftext|> it's", "日本語 naïve \u0000 \U0001F600", "abc" * 50000, "x " * 20000, " " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "hi"), (3, texts[3])]
    got = (docs(rows).withColumn("ids", bpe.encode(F.col("text"), TOKENS, public_tokenizers.PATTERN))
           .withColumn("back", bpe.decode(F.col("ids"), TOKENS)).withColumn("digest", bpe.ids_digest(F.col("ids"))).collect())
    assert len(got) == len(rows)
    for r in got:
        want = REFERENCE.encode_ordinary(r.text or "")
        assert r.ids == want and bytes(r.back).decode() == (r.text or "")
        assert r.digest == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert docs([]).select(bpe.encode(F.col("text"), TOKENS, public_tokenizers.PATTERN)).collect() == []


def test_bad_ids_and_files(spark, tmp_path):
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([1, 99999999],)], "ids array<int>").select(bpe.decode(F.col("ids"), TOKENS)).collect()
    (tmp_path / "short").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.load_ranks(str(tmp_path / "short"))


def test_query_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"][0](spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = REFERENCE.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_array_splits_equal_the_pattern():
    rnd = random.Random(5)
    letters = " \n\t'sdtrevml19é日ABCabc_=-!　\xa0\x85\x1c​́Ⅷ²\0\r ᠎\U0001F600"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += ["".join(rnd.choice(" 'strevmld\n") for _ in range(rnd.randrange(12))) for _ in range(4000)]
    texts += [f"{chr(i)}'s {chr(i)}{chr(i)} a{chr(i)}" for i in range(0x3000)]
    parts, first = ENCODER._parts(texts)
    parts = [p.decode() for p in byte_strings(parts)]
    assert [parts[i:j] for i, j in zip(first, first[1:])] == [ENCODER.split(t) for t in texts]


def test_other_patterns_are_matched_as_they_are():
    other = bpe.Encoder(bpe.model_proto(TOKENS), r"\p{L}+|\d")
    for text in ("don't stop 12 naïve", "", "!!", "日本語 x"):
        want = [i for part in re.findall(r"[^\W\d_]+|\d", text) for i in REFERENCE.encode_ordinary(part)]
        assert unpacked(other([text])[0]) == want


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def __getattr__(self, name):
        return getattr(self.model, name)

    def encode(self, text):
        self.calls += 1
        return self.model.encode(text)


def test_new_words_go_to_the_model_together_and_once(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 0)
    encoder = bpe.Encoder(bpe.model_proto(TOKENS), public_tokenizers.PATTERN)
    encoder.model = Counted(encoder.model)
    texts = [" ".join(f"qzx{chr(97 + i % 26)}{chr(97 + i // 26)}jkv" for i in range(600)) for _ in range(20)]
    assert [unpacked(r) for r in encoder(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]
    assert encoder.model.calls < 10


def test_no_lookup_holds_more_than_a_piece_of_a_batch(monkeypatch):
    encoder, held = bpe.Encoder(bpe.model_proto(TOKENS), public_tokenizers.PATTERN), []
    known = encoder.known
    encoder.known = lambda parts: held.append(sum(map(len, byte_strings(parts)))) or known(parts)
    texts = ["some words " * 60_000, "", "others here " * 50_000, "naïve " * 10]
    assert [unpacked(r) for r in encoder(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]
    assert sum(held) == sum(len(t.encode()) for t in texts) and max(held) <= PIECE_BYTES


def test_a_worker_hands_freed_memory_back_after_a_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(frames, "spare_memory", lambda: calls.append(1))
    assert frames.column_udf(lambda column: column, "int").func(pa.array([1, 2])).to_pylist() == [1, 2]
    assert calls == [1]
