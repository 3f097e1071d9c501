import random
import re

import pytest

from codeweave.llm import neardup
from codeweave.llm.components import components
from codeweave.llm.neardup import Likeness, near_duplicates, spanning, without_near_duplicates
from codeweave.operators import prefix


def sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows, least=85):
    s = sets(rows)
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for x in ids:
        for y in ids:
            if x < y and s[x] and 100 * len(s[x] & s[y]) >= least * len(s[x] | s[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return sorted((i, len(s[i]), root(i), root(i) == i) for i in ids)


def rows():
    rnd = random.Random(12)
    word = lambda: rnd.choice("aBcdEé") + str(rnd.randrange(3000))
    texts = [None, "", " \n", "one", "ONE", "one two", "one two ", "a b c d", "a b c d e", "a b c d e f", "x" * 50000]
    for _ in range(40):
        base = [word() for _ in range(rnd.choice([6, 20, 80, 300]))]
        for _ in range(rnd.choice([0, 1, 2, 8])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    hub = [word() for _ in range(400)]
    for k in range(60):  # copies that differ more from each other than from the hub
        copy = list(hub)
        for j in range(5):
            copy[(k * 7 + j * 71) % 400] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(hub)] + [texts[30]] * 6
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return list(zip(order, texts))


@pytest.mark.parametrize("region,block", [(1024, 1_000_000), (4, 900)])
def test_components_equal_brute_force(spark, docs, monkeypatch, region, block):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = near_duplicates(docs(rows()).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows())


def test_lower_threshold_and_rows_that_stay(spark, docs):
    like = Likeness(80, 100, 5)
    want = brute(rows(), 80)
    assert sorted(tuple(r) for r in near_duplicates(docs(rows()), like=like).collect()) == want
    kept = without_near_duplicates(docs(rows()), like=like)
    assert kept.columns == docs(rows()).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in want if k]


def test_null_keys_repeated_rows_and_clashing_columns(spark, docs):
    data = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (7, "other words")]
    got = sorted((tuple(r) for r in near_duplicates(docs(data)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (7, 1, 7, True)], key=str)
    assert near_duplicates(docs([])).collect() == []
    extra = spark.createDataFrame([(1, "x y", 3, 4), (2, "x Y", 5, 6)], "doc_id long, text string, cluster int, key int")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(extra).collect()) == [(1, 1), (2, 1)]


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = sorted((i, root(i)) for i in list(up) if any(i in p and p[0] != p[1] for p in links))
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_spanning_forest_and_depths():
    import numpy as np
    adjacent = {(i, j) for i in range(20) for j in range(20) if abs(i - j) == 5}
    forest = spanning(20, lambda i, rest: np.array([(i, j) in adjacent for j in rest]))
    assert {n: r for n, r in forest} == {n: n % 5 for n in range(5, 20)}
    assert Likeness(85).deep == 4 and Likeness(80).deep == 3


def test_one_large_cluster_is_summed_over_many_ranges(spark, monkeypatch):
    ranges, dealt = [], prefix.ranged

    def watched(*args):
        out = dealt(*args)
        ranges.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(prefix, "ranged", watched)
    monkeypatch.setattr(neardup, "BLOCK", 100)
    members = [(k, 3 + k % 50, 1 if k < 3600 else k // 10) for k in range(4000)]
    few = "spark.sql.adaptive.coalescePartitions.enabled"  # would join ranges as small as these
    spark.conf.set(few, "false")
    try:
        got = neardup.in_blocks(spark.createDataFrame(members, "key long, n_shingles long, cluster long")).collect()
    finally:
        spark.conf.unset(few)
    want, before = {}, {}
    for k, n, c in sorted(members, key=lambda m: (m[2], m[1], m[0])):
        want[k] = (n, c, before.get(c, 0) // 100)
        before[c] = before.get(c, 0) + n
    assert {r.key: (r.n_shingles, r.cluster, r.block) for r in got} == want and len(got) == len(members)
    assert sum(ranges) == len(members) and max(ranges) < 3600
