import hashlib
import random
import re
import zlib

import pytest

from codeweave.llm import trie
from codeweave.llm.structure_queries import rebuilt_turns

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in said}
        said = {c: said.get(c - c % 20, [])[:h[c]] + ts[h[c]:] for c, ts in said.items()}
    members = {}
    for c, ts in said.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        below = [sums(k) for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        return sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below)

    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(said[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])), *sums(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, rebuild=True, schema=ROWS):
    turns = trie.marked_turns(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in trie.conversation_trie(*(rebuilt_turns(turns) if rebuild else (turns, turns.select("conv").distinct()))).collect()), key=str)


def sample():
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 64), 100, 119, 999_999_999_999]:
        for turn in range(rnd.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), " ".join(rnd.choice(["a", "B", "c\n"]) for _ in range(rnd.randrange(3)))))
    return rows


@pytest.mark.parametrize("limit", [1 << 14, 3])
def test_trie_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "LIMIT", limit)
    monkeypatch.setattr(trie, "CHUNK", 2)
    monkeypatch.setattr(trie, "FRAGMENT", 2)
    assert built(spark, sample()) == brute(sample())


def test_nulls_ties_repeated_rows_and_empty(spark):
    rows = [(None, 0, "user", "x"), (20, None, None, None), (20, 3, "user", "hello there"), (20, 3, "user", "hello there"), (20, 3, "a", None),
            (21, 0, "user", ""), (22, None, "", ""), (0, 5, "user", "x " * 5000), (1, 1, "user", "x"), (1, None, "user", "y")]
    assert built(spark, rows) == brute(rows)
    assert built(spark, rows, rebuild=False) == brute(rows, rebuild=False)
    assert built(spark, []) == []
    extra = [(c, t, r, x, 1, "z") for c, t, r, x in sample()[:20]]
    assert built(spark, extra, schema=ROWS + ", depth int, conv string") == brute(sample()[:20])


def test_one_long_conversation_among_many(spark, monkeypatch):
    """A chain far beyond a task's limit, and conversations that leave it at many depths."""
    monkeypatch.setattr(trie, "LIMIT", 40)
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(0, t, "user", f"w {t}") for t in range(300)]
    for c in range(1, 9):
        rows += [(c, t, "user", f"w {t}") for t in range(35 * c)] + [(c, 35 * c, "user", f"own {c}")]
    assert built(spark, rows, rebuild=False) == brute(rows, rebuild=False)


def test_centroids_of_random_trees():
    rnd = random.Random(9)
    for n in [1, 2, 3, 10, 400]:
        for reach in (1, 3, n):
            up = [0] + [rnd.randrange(max(0, i - reach), i) for i in range(1, n)]
            values = [[rnd.randrange(10) for _ in range(n)] for _ in range(2)]
            want = [list(v) for v in values]
            for w in want:
                for i in range(n - 1, 0, -1):
                    w[up[i]] += w[i]
            assert trie.balanced_sums(up, values) == want


def test_digests_of_members_over_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(trie, "FRAGMENT", 7)
    rows = [(5, 2, i) for i in range(1000)] + [(5, 3, 8), (6, 2, 9), (6, 2, -4)]
    random.Random(1).shuffle(rows)
    got = {(r.conv, r.depth): r.ends_sha256 for r in trie.member_digests(spark.createDataFrame(rows, "conv long, depth long, path long").repartition(5)).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(5, 2): digest(range(1000)), (5, 3): digest([8]), (6, 2): digest([-4, 9])}
