import random

import pytest
from pyspark.sql import functions as F

from codeweave.sources.profile import described, drift, merged, profile

DDL = "id long, x double, name string, key string, tags array<int>, in0 int"


def rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.gauss(0, 1) if i % 10 else (float("nan") if i % 20 else None), rnd.choice("abc") + str(rnd.randrange(400)), None, [i % 3], i % 7) for i in range(n)]


def test_exact_figures_and_sketch_errors(spark):
    data = rows(30_000)
    found = {r.column_name: r for r in described(profile({"t": spark.createDataFrame(data, DDL).repartition(7), "gone": None})).collect()}
    assert list(found) == ["id", "x", "name", "key", "tags", "in0"]
    x = sorted(r[1] for r in data if r[1] is not None and r[1] == r[1])
    assert all(r.n_rows == 30_000 for r in found.values())
    assert (found["x"].n_null, found["x"].low, found["x"].high) == (1500, x[0], x[-1])
    assert (found["name"].first_text, found["name"].last_text) == (min(r[2] for r in data), max(r[2] for r in data))
    assert found["key"].n_null == 30_000 and found["key"].n_distinct == 0 and found["key"].first_text is None
    for c, exact in (("id", 30_000), ("name", len({r[2] for r in data})), ("tags", 3), ("in0", 7)):
        assert abs(found[c].n_distinct - exact) <= 0.05 * exact, c
    for q, v in zip((.25, .5, .75), found["x"].quartiles):
        assert abs(sum(y <= v for y in x) / len(x) - q) < 0.02
    assert found["name"].quartiles is None


def test_profiles_of_parts_merge(spark):
    df = spark.createDataFrame(rows(6000), DDL)
    whole = {r.column_name: r for r in described(profile({"t": df})).collect()}
    parts = profile({"t": df.where("id % 3 = 0")}).unionByName(profile({"t": df.where("id % 3 > 0")}))
    for r in described(merged(parts)).collect():
        w = whole[r.column_name]
        assert (r.n_rows, r.n_null, r.low, r.high, r.first_text, r.last_text) == (w.n_rows, w.n_null, w.low, w.high, w.first_text, w.last_text)
        assert abs(r.n_distinct - w.n_distinct) <= 0.05 * max(w.n_distinct, 1)


def test_drift(spark):
    a = spark.createDataFrame(rows(4000), DDL)
    b = a.withColumn("x", F.col("x") + 1).withColumn("name", F.when(F.col("id") % 4 > 0, F.col("name"))).withColumn("in0", F.col("in0").cast("long")).drop("key") \
         .withColumn("new", F.lit(1))
    got = {r.column_name: (r.in_before, r.in_after, r.changed) for r in drift(profile({"t": a}), profile({"t": b})).collect()}
    assert got["id"] == (True, True, []) and got["key"] == (True, False, []) and got["new"] == (False, True, [])
    assert got["x"] == (True, True, ["middle", "range"]) and got["name"][2][-1:] in (["nulls"], ["range"]) and "nulls" in got["name"][2]
    assert got["in0"] == (True, True, ["type"]) and got["tags"] == (True, True, [])
    assert all(r.changed == [] for r in drift(profile({"t": a}), profile({"t": a.repartition(5)})).collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], DDL)
    assert all((r.n_rows, r.n_distinct, r.low) == (0, 0, None) for r in described(profile({"t": empty})).collect())
    with pytest.raises(TypeError):
        profile({})
