"""Retrieval kernel against brute force: ties, constant matrices, k larger
than the pool, leave-one-out, fusion modes, eval blocks over the budget."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.operators.retrieval import Cosine, Equality, minmax_normalize, topk_similar


def _brute(ev, de, k, mode="single", w=(0.5, 0.5), exclude_self=False):
    def cos(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return float(a @ b / (na * nb))
    pairs = {}
    for i, (va, la) in ev.items():
        for j, (vb, lb) in de.items():
            if exclude_self and i == j:
                continue
            pairs[(i, j)] = (cos(np.array(va), np.array(vb)), 1.0 if la == lb else 0.0)
    s1 = [p[0] for p in pairs.values()]
    s2 = [p[1] for p in pairs.values()]
    out = {}
    for (i, j), (a, b) in pairs.items():
        if mode == "single":
            s = a
        elif mode == "max":
            s = max(a, b)
        else:
            n1 = (a - min(s1)) / (max(s1) - min(s1)) if max(s1) > min(s1) else 0.0
            n2 = (b - min(s2)) / (max(s2) - min(s2)) if max(s2) > min(s2) else 0.0
            s = w[0] * n1 + w[1] * n2
        out.setdefault(i, []).append((-round(s, 6), j))
    return {i: [(j, -s) for s, j in sorted(v)[:k]] for i, v in out.items()}


def _frames(spark, vecs, labels):
    rows = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(vecs, labels))]
    ev = spark.createDataFrame(rows, "eval_id long, v array<double>, lab int")
    de = spark.createDataFrame(rows, "demo_id long, v array<double>, lab int")
    return ev, de, {i: (v, l) for i, v, l in rows}


def _collect(df):
    got = {}
    for r in df.orderBy("eval_id", "rank").collect():
        got.setdefault(r["eval_id"], []).append((r["demo_id"], r["sim"]))
    return got


@pytest.mark.parametrize("mode", ["single", "weighted", "max"])
@pytest.mark.parametrize("distinct", [60, 3])
def test_topk_matches_brute_force(spark, mode, distinct):
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 4, size=(distinct, 4))  # small integers: many exact ties
    vecs = pool[rng.integers(0, distinct, size=60)] if distinct < 60 else pool
    labels = rng.integers(0, 3, size=60)
    ev, de, d = _frames(spark, vecs, labels)
    kinds = [Cosine("v")] if mode == "single" else [Cosine("v"), Equality("lab")]
    got = _collect(topk_similar(ev, de, 4, kinds=kinds, mode=mode, weights=[0.5, 0.5], exclude_self=True))
    want = _brute(d, d, 4, mode=mode, exclude_self=True)
    assert got == want


def test_constant_matrix_and_k_larger_than_pool(spark):
    vecs = np.ones((5, 3))
    ev, de, d = _frames(spark, vecs, [0] * 5)
    got = _collect(topk_similar(ev, de, 10, kinds=[Cosine("v"), Equality("lab")], mode="weighted"))
    assert all(len(v) == 5 for v in got.values())
    assert all(s == 0.0 for v in got.values() for _, s in v)  # constant -> 0, not NaN
    assert [j for j, _ in got[0]] == [0, 1, 2, 3, 4]  # ties -> lower demo id first


def test_sides_split_into_blocks(spark, monkeypatch):
    from codeweave.operators import retrieval
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(40, 8))
    ev, de, d = _frames(spark, vecs, [0] * 40)
    big = topk_similar(ev, de, 3, kinds=[Cosine("v")])
    monkeypatch.setattr(retrieval, "EVAL_ROWS", 7)
    monkeypatch.setattr(retrieval, "DEMO_ROWS", 9)
    small = topk_similar(ev, de, 3, kinds=[Cosine("v")])
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    assert _collect(big) == _brute(d, d, 3)


def test_minmax_normalize(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "d double")
    sim = [r[0] for r in minmax_normalize(df, "d", "n").orderBy("d").select("n").collect()]
    dist = [r[0] for r in minmax_normalize(df, "d", "n", distance=True).orderBy("d").select("n").collect()]
    assert sim == [0.0, 0.5, 1.0] and dist == [1.0, 0.5, 0.0]
    const = spark.createDataFrame([(2.0,), (2.0,)], "d double")
    assert [r[0] for r in minmax_normalize(const, "d", "n", distance=True).select("n").collect()] == [1.0, 1.0]


def _trees(spark, trees):
    rows = [(i, [(d, v) for d, v in t]) for i, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "id long, tree array<struct<depth:int,value:string>>")
    return df.withColumnRenamed("id", "eval_id"), df.withColumnRenamed("id", "demo_id")


@pytest.mark.parametrize("mode", ["single", "weighted", "max"])
def test_near_trees_rank_first_in_every_mode(spark, mode):
    from codeweave.operators.retrieval import TreeDistance
    same, far = [(0, "A"), (1, "B")], [(0, "X"), (1, "Y"), (1, "Z")]
    ev, de = _trees(spark, [same, far, same])
    got = _collect(topk_similar(ev, de, 2, kinds=[TreeDistance("tree")], mode=mode, weights=[1.0]))
    assert [j for j, _ in got[0]] == [0, 2] and got[0][0][1] == 1.0


def test_equal_distances_count_as_one(spark):
    from codeweave.operators.retrieval import TreeDistance
    ev, de = _trees(spark, [[(0, "A")]] * 4)
    for mode in ("single", "weighted", "max"):
        got = _collect(topk_similar(ev, de, 3, kinds=[TreeDistance("tree")], mode=mode, weights=[1.0], exclude_self=True))
        assert all(s == 1.0 for v in got.values() for _, s in v) and [j for j, _ in got[1]] == [0, 2, 3]


def test_empty_sides(spark):
    ev, de, _ = _frames(spark, np.ones((3, 2)), [0] * 3)
    assert topk_similar(ev.limit(0), de, 2, kinds=[Cosine("v")]).collect() == []
    assert topk_similar(ev, de.limit(0), 2, kinds=[Cosine("v")], mode="weighted").collect() == []


def _random_trees(rnd, n):
    out = []
    for _ in range(n):
        depth, tree = 0, []
        for _ in range(rnd.choice([0, 1, 4, 12, 30])):
            tree.append((depth, rnd.choice(["BEGIN", "LOOP", "_", ";", "(", "IF", "UPDATE"])))
            depth = max(0, min(depth + rnd.choice([-1, 0, 0, 1]), 5))
        out.append(tree)
    return out


def test_tree_bounds_hold_and_prune():
    import random

    from codeweave.functions.trees import Tree
    from codeweave.operators import retrieval
    from codeweave.operators.retrieval import TreeDistance, bounded_extrema, bounded_scores
    rnd, kind = random.Random(5), TreeDistance("tree")
    evals, demos = [Tree(t) for t in _random_trees(rnd, 30)], [Tree(t) for t in _random_trees(rnd, 60)]
    exact = kind.scores(evals, demos)
    low, high = kind.bounds(evals, demos)
    assert (low <= exact).all() and (exact <= high).all()
    counts = np.ones(exact.shape, bool)
    counts[3, 4] = False
    lo, hi, scored = bounded_extrema(kind, evals, demos, counts)
    assert (lo, hi) == (exact[counts].min(), exact[counts].max()) and scored < exact.size / 4
    fuse = lambda blocks: retrieval._fused([kind], blocks, "single", None, [(lo, hi)])
    runs = [retrieval._Run(np.arange(len(x)), None, None, [x]) for x in (evals, demos)]
    want = np.rint(fuse([exact]) * retrieval.SCALE).T
    for held in (None, want[:, :3]):
        score, scored = bounded_scores([kind], *runs, 2, fuse, held)
        top = lambda m: np.argsort(-m, axis=1, kind="stable")[:, :2]
        assert scored < exact.size * 0.6 and (held is None) <= (top(score) == top(want)).all()
        assert (score[np.isfinite(score)] == want[np.isfinite(score)]).all()


@pytest.mark.parametrize("mode,exclude_self", [("single", False), ("weighted", True), ("max", False)])
def test_pruned_trees_rank_as_all_pairs(spark, monkeypatch, mode, exclude_self):
    import random

    from codeweave.operators import retrieval
    from codeweave.operators.retrieval import TreeDistance
    monkeypatch.setattr(retrieval, "EVAL_ROWS", 7)
    monkeypatch.setattr(retrieval, "DEMO_ROWS", 9)

    class AllPairs(TreeDistance):
        bounds = property()  # not there: every pair is scored

    ev, de = _trees(spark, _random_trees(random.Random(6), 40))
    vec = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.sin(i * F.col("n")))
    ev, de = ev.withColumn("n", F.col("eval_id")).withColumn("v", vec), de.withColumn("n", F.col("demo_id") + 1).withColumn("v", vec)
    found = [topk_similar(ev, de, 4, kinds=[Cosine("v"), kind("tree")] if mode != "single" else [kind("tree")], mode=mode, weights=[.4, .6],
                          exclude_self=exclude_self).orderBy("eval_id", "rank").collect() for kind in (TreeDistance, AllPairs)]
    assert found[0] == found[1] and len(found[0]) == 160


@pytest.mark.parametrize("mode", ["single", "weighted", "max"])
def test_only_what_beats_the_held_scores_is_sorted(monkeypatch, mode):
    """Not every block of pairs: a block after the first costs a product and a comparison."""
    import pyarrow as pa

    from codeweave.operators import retrieval
    monkeypatch.setattr(retrieval, "EVAL_ROWS", 16)
    monkeypatch.setattr(retrieval, "DEMO_ROWS", 8)
    rng, n = np.random.default_rng(8), 64
    vecs = np.concatenate([rng.normal(size=(n - 8, 6)), rng.integers(1, 3, size=(7, 6)), np.zeros((1, 6))])
    labels = [None if i % 9 == 0 else i % 3 for i in range(n)]
    side = lambda name: pa.table({name: np.arange(n), "_only": np.arange(n), "_first": np.arange(n), "_n": np.ones(n, np.int64),
                                  "v": pa.array(vecs.tolist(), pa.list_(pa.float64())), "lab": pa.array(labels)})
    kinds = [Cosine("v")] if mode == "single" else [Cosine("v"), Equality("lab")]
    extrema, sorted_at_once, argsort = [(-1.0, 1.0), (0.0, 1.0)], [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: sorted_at_once.append(np.size(a)) or argsort(a, *x, **y))
    got = retrieval._topk_fn(kinds, 3, mode, [0.5, 0.5], extrema)(side("_v"), side("_d")).to_pydict()
    assert sum(sorted_at_once) <= n * 8
    unit = vecs / np.where(np.linalg.norm(vecs, axis=1, keepdims=True) == 0, np.nan, np.linalg.norm(vecs, axis=1, keepdims=True))
    same = np.array([[float(a == b) for b in labels] for a in labels])
    score = {"single": unit @ unit.T, "max": np.maximum(unit @ unit.T, same), "weighted": 0.5 * (unit @ unit.T + 1) / 2 + 0.5 * same}[mode]
    score = np.rint(score * 1e6)
    best = argsort(np.where(np.isnan(score), np.inf, -score), axis=1, kind="stable")[:, :3]
    assert dict(zip(zip(got["_v"], got["_d"]), got["sim"])) == {
        (i, int(j)): None if np.isnan(score[i, j]) else score[i, j] / 1e6 for i in range(n) for j in best[i]}


def test_vectors_and_texts_travel_little(spark):
    """vectors are no grouping or join keys, and texts and terms don't travel by key."""
    from codeweave.functions.skeleton import question_skeleton
    from codeweave.operators.retrieval import SparseCosine, tfidf_vectors, topk_similar
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "a b b"), (2, "b c"), (3, None), (4, ""), (5, "b c")]
    df = spark.createDataFrame(rows, "id long, text string")
    lex = spark.createDataFrame([("c", "NN")], "word string, tag string")
    skeleton, vectors = question_skeleton(df, "text", lex, out="q", key="id"), tfidf_vectors(df, "text", "v", key="id")
    assert "hashpartitioning(id" not in plan(skeleton) and "hashpartitioning(id" not in plan(vectors)
    assert dict(skeleton.select("id", "q").collect()) == {1: "a b b", 2: "b _", 3: "", 4: "", 5: "b _"}
    top = topk_similar(vectors.withColumnRenamed("id", "eval_id"), vectors.withColumnRenamed("id", "demo_id"), 2, kinds=[SparseCosine("v")])
    assert "hashpartitioning(v#" not in plan(top)
    assert [(r.demo_id, r.sim) for r in top.where("eval_id = 2").orderBy("rank").collect()] == [(2, 1.0), (5, 1.0)]


def test_terms_of_repeated_and_null_keys_count_together(spark):
    from codeweave.operators.retrieval import tfidf_vectors
    df = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a"), (2, "a")], "id long, text string")
    got = [(r.id, sorted(round(t.weight, 6) for t in r.v)) for r in tfidf_vectors(df, "text", "v", key="id").collect()]
    log = lambda n: round(float(np.log(5 / (n + 1))), 6)
    one = sorted([log(3), round(2 * float(np.log(5 / 2)), 6), log(1)])
    assert sorted(got, key=str) == sorted([(1, one), (1, one), (None, []), (2, [log(3)])], key=str)


def test_digests_are_equal_for_equal_values_only():
    import pyarrow as pa

    from codeweave.operators.retrieval import _digests
    rows = [([1.0, 2.0], "a", 1), ([1.0, 2.0], "a", 1), ([1.0], "a", 1), ([1.0, 2.0], "b", 1), ([1.0, 2.0], "a", None), (None, "a", 1),
            ([], "a", 1), ([0.0], None, 0), ([-0.0], None, 0), ([None], None, 0), ([1.0, 2.0], "a", 1)]
    vectors, names, labels = (pa.array(x, t) for x, t in zip(zip(*rows), (pa.list_(pa.float64()), pa.string(), pa.int32())))
    trees = pa.array([[{"term": len(n or ""), "name": n}] * 2 for n in names.to_pylist()], pa.list_(pa.struct([("term", pa.int64()), ("name", pa.string())])))
    got = _digests([vectors, names, labels, trees])
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            assert (got[i] == got[j]) == (x == y), (x, y)
    assert _digests([c.slice(1) for c in (vectors, names, labels, trees)]) == got[1:]


def test_passing_tables_of_text_skeletons_are_removed(spark, scratch):
    """tables on the way are gone once what came of them is kept; vectors travel to their cells packed."""
    import os

    from codeweave.llm.frames import noted_tables
    from codeweave.plans.registry import all_queries
    rows = [(i, f"the bank {i % 7} of town {i} isn't open, see 4.5 ({i % 3})") for i in range(40)] + [(40, None), (41, ""), (42, "the bank 1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, "bank 3 of town 17"), (2, ""), (3, "(open)")], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    with noted_tables() as made:
        got = all_queries()["text_skeleton_topk"].build(spark, scratch)
    purposes = lambda folders: sorted(path.rsplit("/", 1)[-1].split("-")[0] for path in folders)
    assert purposes(made) == ["codes", "codes", "codes", "skeletons", "values", "values", "vectors"]
    assert purposes(f for f in made if os.path.exists(f.removeprefix("file:"))) == ["values", "values", "vectors"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_rows" in plan and "v_text" not in plan.split("FlatMapCoGroupsInArrow")[1].split("MapInArrow")[0]
    best = {(r.eval_id, r["rank"]): (r.demo_id, r.sim) for r in got.collect()}
    assert len(best) == 9 and best[1, 1][0] == 17 and best[2, 1] == (0, None)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_packed_rows_are_given_back_as_they_are():
    import pyarrow as pa

    from codeweave.llm.frames import packed_rows, unpacked_rows
    vector = pa.list_(pa.struct([("term", pa.int64()), ("weight", pa.float64())]))
    key = pa.array([{"k": 1, "t": "é", "v": [{"term": 1 << 40, "weight": float("nan")}, None]}, None, {"k": None, "t": "", "v": None}, {"k": 2, "t": None, "v": []}],
                   pa.struct([("k", pa.int64()), ("t", pa.string()), ("v", vector)]))
    rows = pa.table({"codes": pa.array([[1, 70_000], [], [0], [2]], pa.list_(pa.int32())), "key": key, "of.list.element": [1, 2, None, 4]})
    for some, bytewise in ((rows, ()), (rows, ("codes",)), (rows.slice(1, 2), ("codes",)), (rows.slice(0, 0), ("codes",))):
        got = unpacked_rows(packed_rows(some, bytewise))
        assert got.schema == some.schema and str(got.to_pylist()) == str(some.to_pylist())


def test_only_carried_columns_come_with_vectors(spark):
    from codeweave.operators.retrieval import tfidf_vectors
    for rows in ([(1, "a b"), (2, "b c")], [(1, "a b"), (1, "b c"), (None, "a")]):
        df = spark.createDataFrame([(*r, 5) for r in rows], "id long, text string, x int")
        whole, part = (tfidf_vectors(df, "text", "v", key="id", carried=c) for c in (None, ["x"]))
        assert whole.columns == ["id", "text", "x", "v"] and part.columns == ["x", "v"]
        assert sorted(str(r.v) for r in whole.collect()) == sorted(str(r.v) for r in part.collect())
