import json
import random

import pytest
from pyspark.sql import functions as F

from codeweave.sources.json_array import read_json_array, starting_states
from codeweave.sources.tasks import read_tasks

DDL = "id long, text string, parts array<struct<name:string,values:array<int>>>, more map<string,string>"


def rows(n):
    rnd = random.Random(3)
    odd = ['{', '}', '[', ']', '"', "\\", '\\"', "}]", "é", "\n", '{"a": "}"}', ",", "\\\\", "\t", "𝄞"]
    text = lambda: "".join(rnd.choice([*odd, "word ", "x"]) for _ in range(rnd.randrange(25)))
    return [{"id": i, "text": text() if i != 7 else "}" * 900, "parts": [{"name": text(), "values": [1, 2]} for _ in range(rnd.randrange(4))],
             "more": {text(): text()}} for i in range(n)]


@pytest.fixture()
def split(spark):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def at(n):
        for c in kept:
            spark.conf.set(c, str(n))
    yield at
    for c, v in kept.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_equal_to_the_single_reader_at_any_split(spark, split, tmp_path, indent):
    for k, n in enumerate([0, 1, 60, 25]):
        (tmp_path / f"{k}.json").write_text(json.dumps(rows(n), indent=indent, ensure_ascii=bool(k % 2)) + "\n" * k, encoding="utf-8")
    want = sorted(map(str, spark.read.schema(DDL).option("multiLine", True).json(str(tmp_path)).collect()))
    assert len(want) == 86
    for size in (97, 1000, 1 << 27):
        split(size)
        got = read_json_array(spark, str(tmp_path), DDL)
        assert sorted(map(str, got.collect())) == want, size


def test_one_file_is_read_by_many_tasks(spark, split, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(rows(400)))
    size = (tmp_path / "a.json").stat().st_size
    split(size // 16)
    df = read_json_array(spark, str(tmp_path), DDL)
    seen = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in seen) == 400 and len([r for r in seen if r["count"] > 5]) >= 12


def test_incomplete_array_raises(spark, tmp_path):
    for k, text in enumerate(['[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": "2}', '[{"id": 1}']):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(ValueError, match="not a complete JSON array"):
            read_json_array(spark, str(tmp_path / f"{k}.json"), DDL)


def test_states_compose():
    """An object over three ranges, a string over two."""
    got = starting_states([("a", 0, 0, 2, 0, 0, 0), ("a", 10, 1, 1, 0, 0, 0), ("a", 20, 1, 0, 0, -4, -4)])
    assert got == {("a", 0): (0, 0, -1), ("a", 10): (0, 2, 0), ("a", 20): (1, 3, 0)}


def test_read_tasks_keeps_its_schema(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"task_id": 3, "text": "a}b", "matched_contents": {"t": ["x"]}}, {"task_id": 4}]))
    got = {r.task_id: r for r in read_tasks(spark, str(tmp_path / "t.json")).collect()}
    assert got[3].text == "a}b" and got[3].matched_contents == {"t": ["x"]} and got[4].text is None
    with pytest.raises(ValueError):
        read_tasks(spark, str(tmp_path), layout="csv")
