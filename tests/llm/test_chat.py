import random

from pyspark.sql import functions as F

from codeweave.llm import chat

TREES = "tree long, node long, parent long, role string, text string, score double"


def read(df):
    return df.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()


def brute_paths(rows, keep):
    """Best branches of each tree by recursion over parents."""
    out = {}
    trees = {}
    for tree, node, parent, role, text, score in rows:
        trees.setdefault(tree, {}).setdefault(node, (parent, role, text, score))
    for tree, nodes in trees.items():
        parents = {p for p, *_ in nodes.values() if p is not None}
        branches = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, seen, at = [], set(), leaf
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(at)
                at = nodes[at][0]
            if at in seen:
                continue
            mean = sum(nodes[n][3] or 0.0 for n in path) / len(path)
            branches.append((-mean, leaf, path[::-1]))
        for _, leaf, path in sorted(branches)[:keep]:
            out[tree, leaf] = [(nodes[n][1] or "", nodes[n][2] or "") for n in path]
    return out


def test_best_branches_of_random_trees(spark):
    rnd = random.Random(8)
    rows = []
    for tree in [*range(12), None]:
        n = rnd.randrange(1, 40)
        for node in range(n):
            parent = None if node == 0 else rnd.choice([rnd.randrange(node), node - 1])
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", None, "sy\nstem"]),
                         rnd.choice(["", None, "</s>", "a\\b", "<|end|>x", "é<|turn|>"]), rnd.choice([None, 0.25, 0.5, 1.0])))
    rows += [(50, 0, 99, "user", "orphan", 1.0), (51, 1, 2, "user", "cycle", 1.0), (51, 2, 1, "user", "cycle", 1.0), (51, 3, 2, "user", "below", 1.0)]
    rows += [(52, i, i - 1 if i else None, "assistant", f"t{i}", 0.0) for i in range(700)]
    for keep in (1, 3):
        got = read(chat.format_paths(chat.branch_paths(spark.createDataFrame(rows, TREES), keep)))
        want = brute_paths(rows, keep)
        assert {(r.tree, r.leaf) for r in got} == set(want)
        for r in got:
            assert [tuple(t) for t in r.turns] == want[r.tree, r.leaf]
            assert r.learnt == [t for role, t in want[r.tree, r.leaf] if role == "assistant"]


def test_escapes_are_reversible(spark):
    rnd = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "|", "s>", "/", "[", "a", "é", "\n", "<\\s>", "<<s>", "end|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(400)] + ["\\" * 5, "x" * 100000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("e", chat.escaped(F.col("text")))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.text
        assert not any(c in r.e for c in chat.CONTROL)


def test_linear_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, node int, score string"
    rows = [(1, 1, "assistant", "b", 0, "x"), (1, 0, "user", "a", 0, "x"), (1, 2, None, None, 0, "x"), (None, None, "user", "n", 0, "x"),
            (2, 5, "user", "same", 0, "x"), (2, 5, "user", "same", 0, "x"), (2, 3, "assistant", "", 0, "x")]
    rows += [(3, i, "assistant" if i % 2 else "user", "é" * (i % 5) + str(i), 0, "x") for i in range(1500)]
    got = {r.tree: r for r in read(chat.format_paths(chat.branch_paths(chat.threads(spark.createDataFrame(rows, schema)))))}
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b"), ("", "")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", ""), ("user", "same"), ("user", "same")]
    assert got[2].learnt == [""] and got[None].learnt == []
    assert got[3].learnt == [r[3] for r in rows if r[0] == 3 and r[2] == "assistant"]
    assert chat.format_paths(chat.branch_paths(chat.threads(spark.createDataFrame([], schema)))).collect() == []
