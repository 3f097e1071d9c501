"""Skeleton trees, tree edit distance goldens and question skeletons."""

import random

from codeweave.functions.skeleton import question_skeleton, skeleton_tree, tree_distance
from codeweave.operators.retrieval import Tree, tree_edit_distance


def recursive(a, b):
    """The distance by its definition, on (value, children) tuples."""
    size = lambda t: 1 + sum(map(size, t[1]))
    d = [[i + j if not (i and j) else 0 for j in range(len(b[1]) + 1)] for i in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            d[i][j] = min(d[i - 1][j] + size(x), d[i][j - 1] + size(y), d[i - 1][j - 1] + recursive(x, y))
    return d[-1][-1] + (a[0] != b[0])


def nested(preorder):
    root = ("ROOT", [])
    path = [root]
    for depth, value in preorder:
        del path[depth + 1:]
        path[-1][1].append((value, []))
        path.append(path[-1][1][-1])
    return root


def test_tree_distance_goldens():
    big = Tree([(0, "A"), (1, "B"), (1, "C"), (0, "D")])
    assert tree_edit_distance(big, Tree([])) == 2  # borders count children, not nodes
    assert tree_edit_distance(big, big) == 0
    assert tree_edit_distance(Tree([(0, "A")]), Tree([(0, "B")])) == 1


def test_tree_distance_equals_its_definition_and_deep_trees_work():
    rnd = random.Random(4)

    def some():
        out, depth = [], -1
        for _ in range(rnd.randrange(9)):
            depth = rnd.randrange(depth + 2)
            out.append((depth, rnd.choice("AB")))
        return out

    for _ in range(300):
        x, y = some(), some()
        assert tree_edit_distance(Tree(x), Tree(y)) == recursive(nested(x), nested(y)), (x, y)
    deep = Tree([(i, "BEGIN") for i in range(3000)])
    assert tree_edit_distance(deep, deep) == 0


def test_skeleton_tree_blocks(spark):
    sk = "CREATE PROCEDURE sp(_) AS $$ BEGIN IF _ THEN UPDATE _ SET _ = _; END IF; END; $$;"
    df = spark.createDataFrame([(sk,)], "s string")
    tree = df.select(skeleton_tree("s").alias("t")).first()["t"]
    pairs = [(x["depth"], x["value"]) for x in tree]
    assert ("BEGIN" in [v for _, v in pairs]) and all(not v.startswith("END") for _, v in pairs)
    depth_of = {v: d for d, v in pairs}
    assert depth_of["BEGIN"] == 0 and depth_of["IF"] == 1 and depth_of["UPDATE"] == 2
    assert pairs[-1] == (0, ";")  # after END IF and END we are back at the root


def test_skeleton_tree_extra_end_stays_at_root(spark):
    df = spark.createDataFrame([("END; END; BEGIN x; END;",)], "s string")
    tree = df.select(skeleton_tree("s").alias("t")).first()["t"]
    assert [(x["depth"], x["value"]) for x in tree] == [(0, ";"), (0, ";"), (0, "BEGIN"), (1, "X"), (1, ";"), (0, ";")]


def test_tree_distance_udf(spark):
    df = spark.createDataFrame([("BEGIN a; END;", "BEGIN b; END;"), ("BEGIN a; END;", "BEGIN a; END;")],
                               "x string, y string")
    trees = df.select(skeleton_tree("x").alias("tx"), skeleton_tree("y").alias("ty"))
    got = [r[0] for r in trees.select(tree_distance("tx", "ty")).collect()]
    assert got == [1.0, 0.0]


def test_question_skeleton(spark):
    df = spark.createDataFrame([(1, "Show the city's banks in 3 states."), (2, "list banks ( all )")],
                               "id long, text string")
    lex = spark.createDataFrame([("city", "NN"), ("banks", "NNS"), ("in", "IN"), ("states", "NNS"), ("Show", "VB")],
                                "word string, tag string")
    got = {r["id"]: r["q"] for r in question_skeleton(df, "text", lex, out="q", key="id").collect()}
    assert got[1] == "Show the _"  # city 's banks in 3 states -> one _
    assert got[2] == "list _ all"


def test_clamped_depths_equal_the_loop():
    import random

    import numpy as np

    from codeweave.functions.skeleton import clamped_depths
    rnd = random.Random(2)
    for n in (0, 1, 5, 200):
        steps, depth, want = [rnd.choice([1, 0, -1, -1]) for _ in range(n)], 0, []
        for s in steps:
            want.append(depth)
            depth = max(0, depth + s)
        assert clamped_depths(np.array(steps, np.int64)).tolist() == want


def test_long_skeletons_and_candidates_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from codeweave.functions.code import clean_candidate
    from codeweave.functions.skeleton import skeleton_tree

    def seconds(column):
        t0 = time.time()
        spark.range(1).select(column).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    for make in (lambda n: skeleton_tree(F.lit("BEGIN _ ; LOOP END " * (n // 5))),
                 lambda n: clean_candidate(F.lit('procedure x ( "a" , b ) ' * (n // 8)), F.array(F.lit("a")))):
        seconds(make(1000))
        assert seconds(make(32_000)) < 8 * max(seconds(make(8_000)), 0.3)
