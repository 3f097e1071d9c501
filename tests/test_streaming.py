"""The streaming job cleans files as they arrive and resumes from its
checkpoint without reprocessing."""

import uuid

from codeweave.streaming.candidates import start_candidate_stream


def test_candidate_stream_resumes(spark, scratch):
    src, sink = f"{scratch}/in", f"{scratch}/out"
    rows = [(1, 0, "CREATE PROCEDURE p(a IN NUMBER) IS BEGIN UPDATE t SET a = 1; END; tail", None, ["t"])]
    ddl = "task_id long, cand_pos int, code string, error string, terms array<string>"
    spark.createDataFrame(rows, ddl).write.parquet(f"{src}/part1")
    name = f"cands_{uuid.uuid4().hex[:8]}"
    q = start_candidate_stream(spark, f"{src}/*", sink, name=name)
    q.awaitTermination()
    first = spark.read.parquet(sink).collect()
    assert len(first) == 1 and first[0]["cleaned"].endswith("END ;") and '"t"' in first[0]["cleaned"]
    spark.createDataFrame([(2, 0, "BEGIN NULL; END;", "boom", ["x"])], ddl).write.parquet(f"{src}/part2")
    q = start_candidate_stream(spark, f"{src}/*", sink, name=name)
    q.awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_candidate_stream_postgres(spark, scratch):
    src, sink = f"{scratch}/in", f"{scratch}/out"
    ddl = "task_id long, cand_pos int, code string, error string, terms array<string>"
    code = "CREATE PROCEDURE p(a integer) LANGUAGE plpgsql AS $ $ BEGIN UPDATE t SET a : = 1; END; $$; tail"
    spark.createDataFrame([(1, 0, code, None, ["t"])], ddl).write.parquet(f"{src}/p1")
    q = start_candidate_stream(spark, f"{src}/*", sink, name=f"pg_{uuid.uuid4().hex[:8]}", dialect="postgres")
    q.awaitTermination()
    row = spark.read.parquet(sink).first()
    assert "$$" in row["cleaned"] and " $ " not in row["cleaned"] and row["cleaned"].endswith("$$ ;")
    assert len(row["fingerprint"]) == 64
