"""Code normalisation, fingerprints / exact match, candidate cleaning and
script splitting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeweave.functions.code import (clean_candidate, code_fingerprint, exact_match, normalize_code,
                                      schema_name_from_path, split_statements)

ORA_A = ("CREATE OR REPLACE PROCEDURE sp(para_id NUMBER) IS record_count NUMBER; BEGIN "
         "SELECT COUNT(*) INTO record_count FROM \"t\" WHERE \"id\" = para_id; END;")
ORA_B = ORA_A.replace("record_count", "record_coun")
ORA_MODE_A = ("CREATE OR REPLACE PROCEDURE sp(para_Gender VARCHAR2) IS BEGIN UPDATE \"people\" SET \"g\" = "
              "para_Gender; END;")
ORA_MODE_B = ("create or replace procedure sp( para_Sex IN VARCHAR2 ) is begin update \"people\" set \"g\"=para_Sex; "
              "end;")
PG_A = ("CREATE OR REPLACE PROCEDURE sp(para_a integer) LANGUAGE plpgsql AS $$ DECLARE ref_cursor CURSOR FOR "
        "SELECT * FROM t WHERE a = para_a; BEGIN OPEN ref_cursor; CLOSE ref_cursor; END; $$;")
PG_B = PG_A.replace("ref_cursor", "ref_cur")
PG_C = PG_B.replace(" BEGIN", "\n   BEGIN  ").replace("; ", " ;  ")


@pytest.mark.parametrize("a,b,dialect,expected", [
    (ORA_A, ORA_B, "oracle", 1),
    (ORA_MODE_A, ORA_MODE_B, "oracle", 1),
    (PG_A, PG_B, "postgres", 1),
    (PG_A, PG_C, "postgres", 1),
    (ORA_A, ORA_A.replace('"t"', '"other_table"'), "oracle", 1),
    (ORA_MODE_A, ORA_MODE_A.replace('UPDATE "people" SET "g" =', 'INSERT INTO "people" VALUES ('), "oracle", 0),
    (ORA_A, ORA_A.replace("END;", "COMMIT; END;"), "oracle", 0),
    (ORA_A, ORA_A.replace('= para_id', '> para_id'), "oracle", 0),
    (PG_A, PG_A.replace("a = para_a", "a > para_a"), "postgres", 0),
])
def test_exact_match_pairs(spark, a, b, dialect, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(exact_match("a", "b", dialect)).first()[0] == expected


def test_exact_match_null_is_false(spark):
    df = spark.createDataFrame([(ORA_A, None)], "a string, b string")
    assert df.select(exact_match("a", "b")).first()[0] == 0


def test_normalize_oracle_examples(spark):
    df = spark.createDataFrame([("create or replace procedure sp( x IN number ) is begin select count ( * ) "
                                 "into v from t where a  =  1 , b; end;",)], "c string")
    got = df.select(normalize_code("c", "oracle")).first()[0]
    # keywords get a blank on both sides after the punctuation squeeze
    assert got == "CREATE OR REPLACE PROCEDURE sp(x NUMBER ) IS BEGIN SELECT COUNT (*) INTO v FROM t WHERE a=1,b; END ;"


def test_normalize_postgres_body_with_lt_is_restored(spark):
    df = spark.createDataFrame([("CREATE PROCEDURE sp() LANGUAGE plpgsql AS $$ BEGIN IF a < 1 THEN x := 2; "
                                 "END IF; END; $$;",)], "c string")
    got = df.select(normalize_code("c", "postgres")).first()[0]
    assert "$$" in got and "@@" not in got and "a<1" in got and "x:=2" in got


def test_fingerprint_groups_same_shape(spark):
    df = spark.createDataFrame([(ORA_A,), (ORA_B,), (ORA_MODE_A,)], "c string")
    fps = [r[0] for r in df.select(code_fingerprint("c")).collect()]
    assert fps[0] == fps[1] != fps[2]


# ---------------------------------------------------------------------------
# candidate cleaning against a plain Python walk over tokens
# ---------------------------------------------------------------------------

def _clean_by_loop(code, terms, dialect="oracle"):
    stop = "END;" if dialect == "oracle" else "$$;"
    at = code.find(stop)
    if at >= 0:
        code = code[:at + len(stop)]
    toks = re.findall(r"\w+|[^\w\s]", code, flags=re.ASCII)
    toks = ['"%s"' % t if t in terms else t for t in toks]
    named = list(toks)
    for i in range(1, len(toks) - 1):
        if toks[i - 1].lower() in ("procedure", "function") and toks[i + 1] == "(":
            named[i] = "sp"
    inside_sp = after_paren = False
    for i, t in enumerate(named):
        inside_sp = inside_sp or t == "sp"
        after_paren = after_paren or t == "("
        if t == ")":
            inside_sp = after_paren = False
        if inside_sp and after_paren:
            named[i] = t.replace('"', "")
    if dialect != "oracle":
        named = ["$$" if t == "$" and j + 1 < len(named) and named[j + 1] == "$" else t for j, t in enumerate(named)]
        named = [t for t in named if t != "$"]
    pairs = {("=", "="), ("<", "="), (">", "="), ("<", ">"), ("!", "="), (":", "="), ("|", "|")}
    out = list(named)
    i = 0
    while i < len(out) - 2:
        if (out[i], out[i + 1]) in pairs:
            out[i], out[i + 1] = out[i] + out[i + 1], ""
        elif out[i:i + 3] == ["'", "%", "'"]:
            out[i], out[i + 1], out[i + 2] = "'%'", "", ""
        i += 1
    text = re.sub(r'" +"', '"', " ".join(out))
    text = re.sub(r"(\d+)\s*\.\s*(\d+)", r"\1.\2", text)
    return re.sub(r'"\s*(.*?)\s*"', r'"\1"', text)


def test_clean_fixture_cases(spark):
    terms = ["bank", "city", "state", "sp"]
    cases = [
        "CREATE OR REPLACE PROCEDURE set_city(state IN VARCHAR2, city IN VARCHAR2) IS BEGIN UPDATE bank SET "
        "city = city WHERE state = state; END; extra words after",
        "CREATE PROCEDURE p(x NUMBER) IS BEGIN IF x > = 0 . 5 AND x < > 2 THEN x : = x | | 'a'; END IF; END;",
        "CREATE PROCEDURE p(x NUMBER) IS BEGIN SELECT * FROM \"bank\" WHERE city LIKE ' % '; END;",
        "procedure q ( a ) is begin null ; end ; = =",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r[0] for r in df.select(clean_candidate("c", F.array(*[F.lit(t) for t in terms]))).collect()]
    assert got == [_clean_by_loop(c, terms) for c in cases]
    assert got[0].startswith("CREATE OR REPLACE PROCEDURE sp ( state IN VARCHAR2")
    assert got[0].endswith("END ;")


def test_clean_random_token_lists(spark):
    rnd = random.Random(7)
    alphabet = ["=", "<", ">", "!", ":", "|", "'", "%", "a", "b", "(", ")", "sp", "procedure", "x", "1", ".", "$"]
    terms = ["a", "x"]
    rows = [(" ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))),) for _ in range(400)]
    for dialect in ("oracle", "postgres"):
        df = spark.createDataFrame(rows, "c string")
        got = [r[0] for r in df.select(clean_candidate("c", F.array(*[F.lit(t) for t in terms]), dialect)).collect()]
        want = [_clean_by_loop(r[0], terms, dialect) for r in rows]
        assert got == want


def test_split_statements_and_schema_name(spark):
    content = "CREATE TABLE a(x INT); -- c\nINSERT INTO a VALUES (1);  ;\nUPDATE a SET x = 2;"
    df = spark.createDataFrame([("dumps/allergy_1.sqlite.sql", content), ("x/My-Db.sql", "")], "f string, c string")
    got = df.select(schema_name_from_path("f").alias("n"), split_statements("c").alias("s")).collect()
    assert got[0]["n"] == "allergy_1"
    assert [(s["stmt_pos"], s["stmt"]) for s in got[0]["s"]] == [(1, "CREATE TABLE a(x INT)"),
                                                                  (2, "UPDATE a SET x = 2")]
    assert got[1]["n"] == "my_db" and got[1]["s"] == []


def test_reserved_words_are_not_names(spark):
    from codeweave.functions.code import exact_match
    pairs = [("BEGIN OPEN c; END;", "BEGIN CLOSE c; END;", 0), ("SELECT a FROM t ORDER BY a", "SELECT a FROM t GROUP BY a", 0),
             ("DELETE FROM t WHERE x IN y", "DELETE FROM t WHERE x LIKE y", 0), ("BEGIN OPEN c; END;", "BEGIN open d; END;", 1),
             ('UPDATE "order" SET a = 1', 'UPDATE "group" SET b = 2', 1)]
    for dialect in ("oracle", "postgres"):
        df = spark.createDataFrame(pairs, "a string, b string, same int")
        for r in df.select("a", "b", "same", exact_match("a", "b", dialect).alias("got")).collect():
            assert r["got"] == r["same"], r


def test_names_of_any_letters(spark):
    from codeweave.functions.code import clean_candidate, exact_match
    df = spark.createDataFrame([("CREATE PROCEDURE f ( x NUMBER ) IS BEGIN UPDATE größe SET läufe = 1 ; END;", ["größe", "läufe"])],
                               "code string, terms array<string>")
    assert df.select(clean_candidate("code", "terms", "oracle")).first()[0] == \
        'CREATE PROCEDURE sp ( x NUMBER ) IS BEGIN UPDATE "größe" SET "läufe" = 1 ; END ;'
    pair = spark.createDataFrame([("UPDATE größe SET ßif = 1", "UPDATE höhe SET längs = 2")], "a string, b string")
    assert pair.select(exact_match("a", "b", "oracle")).first()[0] == 1


ASCII_CODES = [
    "create or replace procedure P ( a IN number ) is begin  if x = 1 then select count ( * ) into y from \"T\" ; end if ; END;",
    "CREATE PROCEDURE p(a IN text, b double precision) LANGUAGE plpgsql AS $$ begin x := f ( 1 , 2 ); exit when not found ; end; $$;",
    "a.INTO_x _if if_ 1if if1 'or' \"and\" or\tand\n\n text.int timestamp timestamptz PLPGSQL", "", " ", "--", "if", "$$if$$",
    " \n raise \t\t exception  when  others then a . b %type ; v t %ROWTYPE := 1 ; where current  of  c ; exit  when not  found ; \r\n",
    "x double  precision , y\x0bDouble Precision\x0c, count(*) , f ( \n * ) \" q \" $$ a $$ b $$ <= >= : = :="]


def test_ascii_rules_equal_unicode_rules(spark):
    from codeweave.functions import code
    df = spark.createDataFrame([(c,) for c in ASCII_CODES], "c string")
    for dialect in ("oracle", "postgres"):
        for r in df.select(*[code._normalized(F.col("c"), dialect, ascii).alias(str(ascii)) for ascii in (True, False)]).collect():
            assert r["True"] == r["False"]


def test_texts_are_tokenised_once_per_row(spark):
    from codeweave.functions.code import clean_candidate
    df = spark.createDataFrame([("sp ( a )",), ("café İF if",), (None,)], "c string")
    plan = df.select(clean_candidate("c", F.array(F.lit("a")), "oracle").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_one_row_group_is_dealt_to_several_tasks(spark):
    from codeweave.plans.registry import spread
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4
