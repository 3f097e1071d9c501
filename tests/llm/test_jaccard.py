import random
from collections import Counter

import numpy as np
import pytest

from codeweave.llm import jaccard
from codeweave.llm.jaccard import Lists, Overlap, jaccard_join, spanning_links

from .test_neardup import brute, rows


@pytest.mark.parametrize("block,bucket", [(1_000_000, 4_000_000), (900, 3000)])
def test_components_equal_brute_force(spark, docs, monkeypatch, block, bucket):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HELD", block // 2)
    monkeypatch.setattr(jaccard, "BUCKET_TEXT", bucket)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 25 if block > 900 else 64)  # a full filter only costs work
    got = jaccard_join(docs(rows()).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == [r[:3] for r in brute(rows(), 80)]


def test_passages_that_many_documents_share(spark, docs):
    """A common passage links short texts, and only those."""
    rnd = random.Random(4)
    word = lambda: "w" + str(rnd.randrange(10 ** 6))
    passage = " ".join(word() for _ in range(60))
    data = [(i, " ".join([word() for _ in range(rnd.choice([0, 2, 30, 400]))] + [passage] + [word() for _ in range(rnd.choice([0, 3, 40]))])) for i in range(150)]
    got = sorted(tuple(r) for r in jaccard_join(docs(data).repartition(4)).collect())
    assert got == [r[:3] for r in brute(data, 80)] and len({r[2] for r in got}) > 50


def test_null_keys_repeated_rows_and_clashing_columns(spark, docs):
    data = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (7, "other words"), (8, ""), (3, None)]
    got = sorted((tuple(r) for r in jaccard_join(docs(data)).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (4, 2, 4), (4, 2, 4), (9, 2, 4), (7, 1, 7), (8, 0, 8), (3, 0, 3)], key=str)
    assert jaccard_join(docs([])).collect() == []
    extra = spark.createDataFrame([(1, "x y", 3, 4, "p"), (2, "x Y", 5, 6, "q")], "doc_id long, text string, cluster int, key int, a string")
    assert sorted(tuple(r) for r in jaccard_join(extra).collect()) == [(1, 1, 1), (2, 1, 1)]


def near(rnd, n, size, kinds):
    base = rnd.sample(range(kinds), size)
    out = []
    for _ in range(n):
        own = set(base)
        for _ in range(rnd.randrange(size // 3)):
            own ^= {rnd.randrange(kinds)}
        out.append(np.array(sorted(own), np.uint64))
    return out


@pytest.mark.parametrize("heap,probe", [(1000, 30), (10 ** 9, 0), (0, 10 ** 9), (0, 0)])
def test_heap_merge_with_probes_finds_what_counting_finds(monkeypatch, heap, probe):
    monkeypatch.setattr(jaccard, "HEAP", heap)
    monkeypatch.setattr(jaccard, "PROBE", probe)
    rnd = random.Random(6)
    for least in (60, 80, 95):
        like = Overlap(least, 100, 5)
        sets = sorted([s for _ in range(6) for s in near(rnd, 15, rnd.choice([4, 12, 60]), 200)], key=len)
        lists = Lists(sets, np.arange(len(sets)), like)
        for s in sets:
            want = [i for i, o in enumerate(sets) if len(s) and 100 * len(np.intersect1d(s, o)) >= least * len(np.union1d(s, o))]
            assert sorted(lists.search(s).tolist()) == want
        merged = lists._merged(np.arange(40), 5, 80, 3)
        count = Counter(int(m) for k in range(40) for m in lists.entries[lists.first[k]:lists.first[k] + lists.count[k]])
        assert merged == {m: c for m, c in count.items() if c >= 3 and 5 <= m < 80}


def test_links_span_a_large_group_of_copies():
    rnd = random.Random(7)
    sets = sorted(near(rnd, 400, 50, 10 ** 6) + near(rnd, 30, 50, 10 ** 6), key=len)
    like = Overlap()
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if like.linked(len(np.intersect1d(s, sets[j])), len(s), len(sets[j])):
                up[max(root(i), root(j))] = min(root(i), root(j))
    links = spanning_links(sets, like)
    assert len(links) == len(sets) - len({root(i) for i in range(len(sets))})
    assert all(root(a) == root(b) for a, b in links)
