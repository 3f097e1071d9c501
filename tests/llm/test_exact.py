import hashlib
import random
from collections import defaultdict

from codeweave.llm.exact import duplicates, identities, without_duplicates

UP = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows():
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcÄß \n") for _ in range(999))
    texts = [None, "", "A", "a", "Ä", "ä", "abcd", "ABCD", "abcde", "abcdabcd", "abcdabcde", "abcdabcdabcd", long, long.upper().lower(),
             long[:-1], long + "x", "x" + long, long, "ß\U0001F600" * 7, " ", "  "]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, "A"), (None, None), (2, "A"), (5, "other"), (40, "other"), (41, long)]
    return out + [(100 + i, "hot Copy" * 9) for i in range(60)]


def test_groups_equal_brute_force_at_any_block_size(spark, docs):
    for block in (4, 2048):
        got = [tuple(r) for r in duplicates(docs(rows()), block_chars=block).collect()]
        assert sorted(got, key=str) == brute(rows())


def test_names_differ_for_different_texts(spark, docs):
    found = identities(docs([r for r in rows() if r[0] is not None]), block_chars=3).collect()
    by = defaultdict(set)
    for r in found:
        by[(r.level, r.name)].add(r.text_sha256)
    assert all(len(s) == 1 for s in by.values())
    assert len(by) == len({r.text_sha256 for r in found})


def test_kept_rows_empty_table_and_clashing_columns(spark, docs):
    kept = without_duplicates(docs(rows()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted({(i, t) for i, _, _, k, t in brute(rows()) if k}, key=str)
    got = sorted(((r.doc_id, hashlib.sha256((r.text or "").translate(UP).encode()).hexdigest()) for r in kept.collect()), key=str)
    assert got == want
    assert duplicates(docs([])).collect() == []
    extra = spark.createDataFrame([(1, "x", 5, 6, "n"), (2, "X", 7, 8, "m")], "doc_id long, text string, name int, level int, key string")
    assert sorted((r.doc_id, r.kept) for r in duplicates(extra).collect()) == [(1, False), (2, True)]
    assert without_duplicates(extra).collect()[0].name == 7
