"""AUC, coverage@k, evaluation report and candidate choice against brute force."""

import itertools
import random

from codeweave.operators.candidates import PLACEHOLDER, first_valid_candidate
from codeweave.operators.metrics import auc, contains_all, coverage_at_k, evaluation_report


def _auc_brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = auc(df, "y", "s").first()["auc"]
    assert abs(got - _auc_brute(rows)) < 1e-12
    neg = spark.createDataFrame([(y, -s) for y, s in rows], "y int, s double")
    assert abs(got + auc(neg, "y", "s").first()["auc"] - 1.0) < 1e-12


def _coverage_brute(groups, max_k, only_pos):
    res = {k: 0 for k in range(1, max_k + 1)}
    total = 0
    for items in groups.values():
        pos = {p for p, s, y in items if y}
        if only_pos and not pos:
            continue
        total += 1
        ranked = [p for p, s, y in sorted(items, key=lambda x: (-x[1], x[0]))]
        for k in res:
            if pos <= set(ranked[:k]):
                res[k] += 1
    return res, total


def test_coverage_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(g, p, float(rnd.randint(0, 5)), rnd.random() < 0.3) for g in range(50) for p in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, p int, s double, y boolean")
    groups = {}
    for g, p, s, y in rows:
        groups.setdefault(g, []).append((p, s, y))
    for only in (False, True):
        got = {r["k"]: (r["covered"], r["total"]) for r in
               coverage_at_k(df, group=["g"], score="s", pos="p", label="y", max_k=12, only_with_positives=only).collect()}
        want, total = _coverage_brute(groups, 12, only)
        assert got == {k: (v, total) for k, v in want.items()}
        assert [got[k][0] for k in sorted(got)] == sorted(got[k][0] for k in got)  # monotone in k


def test_evaluation_report(spark):
    rows = [(1, 1, 1, 1, 0, 0, 0, 0, 2.0), (0, 0, 0, 1, 0, 0, 1, 0, 4.0), (1, 0, 1, 0, 1, 0, 1, 0, 6.0)]
    df = spark.createDataFrame(rows, "ex int, em int, ok int, insert int, update int, delete int, `if` int, "
                                     "loop int, secs double")
    r = evaluation_report(df, ex="ex", em="em", no_error="ok", seconds="secs").first()
    assert (r["n"], r["accurate"], r["exact"], r["no_error"]) == (3, 2, 1, 2)
    assert r["insert_acc"] == 0.5 and r["update_acc"] == 1.0 and r["delete_acc"] == 0.0 and r["if_acc"] == 0.5
    assert r["total_seconds"] == 12.0 and r["mean_seconds"] == 4.0


def test_first_valid_candidate_cases(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", None),                      # first valid
            (2, 0, "x", "e"), (2, 1, "y", "e"), (2, 2, "z", None),     # third valid
            (3, 0, "first", "e"), (3, 1, "second", "e"),              # none valid, first not blank
            (4, 0, "  \n", "e"), (4, 1, "other", "e")]                 # none valid, first blank
    df = spark.createDataFrame(rows, "task_id int, cand_pos int, code string, error string")
    got = {r["task_id"]: (r["chosen_pos"], r["code"], r["no_error"]) for r in first_valid_candidate(df).collect()}
    assert got == {1: (0, "a", 1), 2: (2, "z", 1), 3: (0, "first", 0), 4: (None, PLACEHOLDER, 0)}


def test_contains_all(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 1]), ([1], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(contains_all("a", "b")).collect()] == [1, 0]


def test_coverage_of_a_positive_without_score(spark):
    df = spark.createDataFrame([(1, 0, None, 1), (1, 1, 0.5, 0), (1, 2, 0.4, 0)], "g int, p int, s double, y int")
    got = [r["covered"] for r in coverage_at_k(df, group=["g"], score="s", pos="p", label="y", max_k=3).orderBy("k").collect()]
    assert got == [0, 0, 1]
