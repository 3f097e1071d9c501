import random

import pytest
from pyspark.sql import functions as F

from codeweave.functions.code import code_fingerprint, exact_match, fingerprint_tokens
from codeweave.functions.code_tree import code_tree, compare_code, first_difference, first_path, parse

GOLD = ("CREATE OR REPLACE PROCEDURE sp(a IN NUMBER, b IN NUMBER) IS BEGIN FOR i IN 1..10 LOOP IF a > 1 THEN UPDATE t SET x = (a + (b * 2)); "
        "ELSE BEGIN DELETE FROM t WHERE x = 'it''s'; INSERT INTO t VALUES (1, .5, 1e5); END; END IF; END LOOP; "
        "x := CASE WHEN a = 1 THEN 2 ELSE 3 END; END;")


def pairs(spark, rows, dialect="oracle"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, gold string, pred string")
    out = df.select("id", first_difference("gold", "pred", dialect).alias("d"), exact_match("gold", "pred", dialect).alias("em"))
    return [(r.d, r.em) for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("dialect", ["oracle", "postgres"])
def test_literals_are_one_class(spark, dialect):
    texts = [("x := 'it''s';", "x := 'other';"), ("x := '';", "x := 'a'';b''c';"), ("x := 1e5;", "x := 7;"), ("x := .5;", "x := 3;"),
             ("x := 1.5E-3;", "x := 2;"), ("FOR i IN 1..10 LOOP x := 1; END LOOP;", "FOR j IN 0..9 LOOP y := 2; END LOOP;")]
    assert pairs(spark, texts, dialect) == [(None, 1)] * len(texts)
    toks = spark.range(1).select(fingerprint_tokens(F.lit("a.b 1..2 'x''y''''z' .5e+3"), "oracle").alias("t")).first().t
    assert toks == ["<IDENTIFIER>", "<NUMBER>", "..", "<NUMBER>", "<STRING>", "<NUMBER>"]
    assert pairs(spark, [("x := '" + "a" * 3000 + "';", "x := 'b';")], dialect) == [(None, 1)]


def test_first_differing_path(spark):
    head = "1:STATEMENT"
    loop = f"{head}/8:BEGIN/1:STATEMENT/7:LOOP"
    inner = f"{loop}/1:STATEMENT/1:IF/2:STATEMENT/2:BEGIN"
    rows = [(GOLD, GOLD.replace(" t ", " other ").replace("'it''s'", "'x'")),
            (GOLD, GOLD.replace("x = 'it''s'", "x > 'it''s'")),
            (GOLD, GOLD.replace("(a + (b * 2))", "(a + (b / 2))")),
            (GOLD, GOLD.replace("ELSE 3 END", "END")),
            (GOLD, GOLD.replace("INSERT INTO t VALUES (1, .5, 1e5); ", "")),
            (GOLD, None), (None, None), (GOLD, "")]
    got = pairs(spark, rows)
    assert got[0] == (None, 1)
    assert got[1][1] == 0 and got[1][0].startswith(inner + "/1:STATEMENT/")
    assert got[2][0] == f"{loop}/1:STATEMENT/1:IF/1:STATEMENT/10:(/1:STATEMENT/3:(/1:STATEMENT/2:*"
    assert got[3][0].endswith("CASE/1:STATEMENT/7:ELSE")
    assert got[4][0] == inner + "/2:STATEMENT"
    assert got[5] == ("", 0) and got[6] == (None, 0) and got[7][0] == "1:STATEMENT"


def test_same_shape_means_no_difference(spark):
    """Equal flat fingerprints, equal trees, no difference: all three agree."""
    rnd = random.Random(3)

    def text():
        out = []
        for _ in range(rnd.randrange(1, 14)):
            out.append(rnd.choice(["BEGIN", "END;", "END IF;", "IF a THEN", "x := (1", ")", ";", "LOOP", "END LOOP;", "CASE WHEN"]))
        return " ".join(out)

    texts = [text() for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in texts[:20] for b in texts[20:]] + [(t, t) for t in texts], "a string, b string")
    root = lambda c: F.element_at(code_tree(c), 1)["fingerprint"]
    got = df.select((code_fingerprint("a") == code_fingerprint("b")).alias("flat"), (root("a") == root("b")).alias("tree"),
                    first_difference("a", "b").isNull().alias("none")).collect()
    assert all(r.tree == r.none for r in got) and all(r.tree for r in got if r.flat) and sum(r.flat for r in got) >= 60
    told = compare_code(df, "a", "b").select("same", F.col("first_difference").isNull().alias("none")).collect()
    assert all(bool(r.same) <= r.none for r in told)


def test_marks_lead_to_the_difference_in_one_pass():
    deep = ["("] * 5000 + ["x"] + [")"] * 5000
    other = list(deep)
    other[5000] = "y"
    assert first_path(parse(deep), parse(deep)) is None
    path = first_path(parse(deep), parse(other))
    assert len(path) == 10_002 and path[-1] == "1:x"
    assert first_path(parse(["a"]), parse(["a", "b"]))[-1] == "2:b"
    assert parse([")", "END", "IF"]).children == []


def test_nodes_of_the_tree(spark):
    rows = spark.range(1).select(F.explode(code_tree(F.lit("BEGIN x := (1); IF a THEN y; END IF; END;"))).alias("n")).select("n.path", "n.kind").collect()
    block = "1:STATEMENT/1:BEGIN"
    assert [tuple(r) for r in rows] == [
        ("", "CODE"), ("1:STATEMENT", "STATEMENT"), (block, "BEGIN"), (f"{block}/1:STATEMENT", "STATEMENT"), (f"{block}/1:STATEMENT/3:(", "("),
        (f"{block}/1:STATEMENT/3:(/1:STATEMENT", "STATEMENT"), (f"{block}/2:STATEMENT", "STATEMENT"), (f"{block}/2:STATEMENT/1:IF", "IF"),
        (f"{block}/2:STATEMENT/1:IF/1:STATEMENT", "STATEMENT")]
