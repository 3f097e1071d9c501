import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from codeweave.llm.mixing import mix, mixed


def targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare round by round until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in held)
        heavy = sum(weight[s] for s in order if s not in held)
        share = {s: most * sizes[s] if s in held else weight[s] * left / heavy for s in order}
        above = {s for s in order if s not in held and share[s] > most * sizes[s]}
        if not above:
            return share
        held |= above


def rows():
    rnd = random.Random(4)
    out = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "B", None, "é", "tiny"] if i < 60 else ["a", "b", "B", None, "é"])
        n = int(rnd.lognormvariate(4, 1.2))
        out.append((i, " ".join(["w"] * n) if i % 97 else None, "en", source, 0))
    return out + [(5, "a b", "en", "a", 0)] * 3 + [(None, "x y", "en", None, 0)]


def test_targets_copies_and_reruns(spark, docs):
    data = rows()
    got = mix(docs(data), [5, 2, 1]).select("doc_id", "source", "_mix.*").collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    biggest = defaultdict(int)
    for r in got:
        biggest[r.source] = max(biggest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 * biggest[s], (s, taken[s], t)
    again = mix(docs(data[::-1]).repartition(7), [5, 2, 1]).select("doc_id", "source", "_mix.*").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixed(docs(data), [5, 2, 1])
    assert out.columns == docs(data).columns and out.count() == sum(r.copies for r in got)


def test_one_source_empty_and_clashing_columns(spark, docs):
    one = mix(docs([(i, "a b c") for i in range(0, 30, 3)]), [5, 2, 1]).select("_mix.copies").collect()
    assert {r.copies for r in one} == {1}
    assert mix(docs([]), [5, 2, 1]).collect() == []
    assert [r.copies for r in mix(docs([(1, ""), (2, None)]), [5]).select("_mix.copies").collect()] == [0, 0]
    extra = docs([(1, "a b"), (2, "c")]).withColumn("size", F.lit("s")).withColumn("target", F.lit(9)).withColumn("_mix", F.lit(0))
    assert {r.size for r in mixed(extra, [1]).collect()} == {"s"}
