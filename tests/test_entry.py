"""The driver contract: entry() and every registered query run on the
smallest tables, oracle names are a subset of the queries."""

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["eval_id", "rank", "demo_id", "sim"]
    assert df.count() > 0


def test_oracle_names_subset():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_runs(spark):
    for name, build in entry.queries().items():
        df = build(spark, SMOKE)
        df.write.format("noop").mode("overwrite").save()
