"""What the columns of tables hold, from one pass over each table, and how two
states of a database differ in it.

Row, null and extreme counts are exact; distinct values and quantiles are sketches
(HyperLogLog, KLL) that merge, so the profile of a table is the merged profile of its
parts, however they were read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, NumericType, StructType

QUARTILES = (0.25, 0.5, 0.75)


def _profiled(field, at: Column) -> Column:
    """The figures of one column as aggregates."""
    numeric = isinstance(field.dataType, NumericType)
    nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
    text = F.to_json(at) if nested else at.cast("string")
    number = at.cast("double") if numeric else F.lit(None).cast("double")
    number = F.when(~F.isnan(number), number)
    own = at.cast("long") if isinstance(field.dataType, IntegralType) else text
    shown = F.lit(None).cast("string") if numeric else text
    return F.struct(
        F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"),
        F.count(F.lit(1)).alias("n_rows"), F.count_if(at.isNull()).alias("n_null"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.min(shown).alias("first_text"), F.max(shown).alias("last_text"),
        F.hll_sketch_agg(own).alias("values_sketch"), F.kll_sketch_agg_double(number).alias("order_sketch"))


def profile(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row for each column of the tables (None: left out): table_name, column_name,
    data_type, n_rows, n_null; low and high of a numeric column (NaN left out), first_text
    and last_text of any other one; and both sketches (quantiles of numeric columns
    only).  A table is read once."""
    parts = []
    for name, df in tables.items():
        if df is not None and df.columns:
            plain = df.toDF(*(f"in{i}" for i in range(len(df.columns))))
            row = plain.agg(F.array(*(_profiled(f, F.col(f"in{i}")) for i, f in enumerate(df.schema.fields))).alias("columns"))
            parts.append(row.select(F.lit(name).alias("table_name"), F.explode("columns").alias("c")).select("table_name", "c.*"))
    return reduce(DataFrame.unionByName, parts)


def merged(profiles: DataFrame) -> DataFrame:
    """Profiles of parts of the same tables as one: figures added up, sketches merged."""
    return profiles.groupBy("table_name", "column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"),
        F.hll_union_agg("values_sketch").alias("values_sketch"), F.kll_merge_agg_double("order_sketch").alias("order_sketch"))


def described(profiles: DataFrame) -> DataFrame:
    """Profiles with n_distinct (an estimate) and quartiles (of rows with a number) instead
    of the sketches."""
    return profiles.withColumn("n_distinct", F.hll_sketch_estimate("values_sketch")).withColumn("quartiles", _quantiles(*QUARTILES)) \
                   .drop("values_sketch", "order_sketch")


def _quantiles(*ranks: float) -> Column:
    """The values at the ranks; null where a column has no number."""
    known = F.kll_sketch_get_n_double("order_sketch") > 0
    sketch = F.when(known, F.col("order_sketch"))
    return F.when(known, F.array(*(F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in ranks)))


def drift(before: DataFrame, after: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """How each column of two profiles differs: in_before, in_after, and ``changed``, the
    sorted list of what does: ``type``, ``rows`` and ``distinct`` (by more than a share of
    ``tolerance``), ``nulls`` (their share, by more than ``tolerance``), ``range`` (any
    extreme), ``middle`` (the median now was further than ``tolerance`` from the middle
    rank before)."""
    a, b = (described(p).select("table_name", "column_name", F.struct("*").alias(side)) for p, side in ((before, "a"), (after, "b")))
    middle = before.select("table_name", "column_name", _quantiles(0.5 - tolerance, 0.5 + tolerance).alias("middle"))
    both = a.join(b, ["table_name", "column_name"], "full_outer").join(middle, ["table_name", "column_name"], "left")
    x, y = F.col("a"), F.col("b")
    apart = lambda c: F.abs(x[c] - y[c]) > tolerance * F.greatest(x[c], y[c])
    share = lambda s: s["n_null"] / F.greatest(s["n_rows"], F.lit(1))
    extremes = reduce(lambda m, n: m | n, (~x[c].eqNullSafe(y[c]) for c in ("low", "high", "first_text", "last_text")))
    moved = ~y["quartiles"][1].between(F.col("middle")[0], F.col("middle")[1])
    tests = {"distinct": apart("n_distinct"), "middle": moved, "nulls": F.abs(share(x) - share(y)) > tolerance,
             "range": extremes, "rows": apart("n_rows"), "type": x["data_type"] != y["data_type"]}
    changed = F.filter(F.array(*(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & t, F.lit(n)) for n, t in tests.items())), lambda c: c.isNotNull())
    return both.select("table_name", "column_name", x.isNotNull().alias("in_before"), y.isNotNull().alias("in_after"), changed.alias("changed"))
