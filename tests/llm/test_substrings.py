import hashlib
import random
import re

import pytest

from codeweave.llm import substrings
from codeweave.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(9)
    word = lambda: rnd.choice(["a", "bé", "ccc", "日", "x,"]) + str(rnd.randrange(400))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (49, 50, 51, 80, 200)]
    texts = [None, "", " \n ", "a b c"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            parts += prose(rnd.randrange(0, 60)) + rnd.choice(passages)[:rnd.choice([30, 60, 300])]
        texts.append("".join(w + rnd.choice([" ", "\n", "  ", "\t"]) for w in parts)[:rnd.choice([None, -1])])
    copy = " ".join(prose(150))
    texts += [copy] * 5 + [copy + " tail", "head " + copy, " ".join(["same"] * 300), " ".join(["same"] * 120), " ".join(prose(30000) + passages[4])]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    out = [(k * 3, t) for k, t in zip(order, texts)]
    return out + [(None, copy), (None, copy), (6, " ".join(passages[3])), (6, " ".join(passages[3])), (-5, " ".join(passages[2])),
                  (1 << 60, copy)]


@pytest.mark.parametrize("bucket_text", [4_000_000, 3000])
def test_equal_to_brute_force(spark, docs, monkeypatch, bucket_text):
    monkeypatch.setattr(substrings, "BUCKET_TEXT", bucket_text)
    got = substrings.remove_repeats(docs(rows()).repartition(5)).collect()
    assert sorted(((r.key, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows())
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)


def test_cover_meets_every_pair_of_residues():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + s) % substrings.PERIOD in substrings.COVER and (j + s) % substrings.PERIOD in substrings.COVER
                       for s in range(substrings.PERIOD))


def test_other_windows_empty_table_and_clashing_columns(spark, docs):
    got = substrings.remove_repeats(docs(rows()), window=31).collect()
    assert sorted(((r.key, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows(), 31)
    assert substrings.remove_repeats(docs([])).collect() == []
    extra = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, bucket int, kind int")
    assert substrings.remove_repeats(extra).collect()[0].kept_text == "a b"


def test_query_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op5_cover_substrings"][0](spark, d).collect())
    table = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(table))
