"""Global running sums without a single-task window.

Rows are dealt out by ranges of the whole order key (all its columns, exact
values: no numeric image), each range is summed in parallel, the range totals (one
row for each range) get their own running sum, and every row adds its range's
offset to a window that is partitioned by range.

NULL order keys come first and NaN last, as in Spark's ascending sort.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ranged(df: DataFrame, order_cols: Sequence[str], n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: contiguous, ascending in ``order_cols``; rows with equal
    keys share a range.  ``n_ranges`` defaults to the session's shuffle partitions.
    Written once, so that every later reader sees the same ranges."""
    cols = [F.col(c).asc_nulls_first() for c in order_cols]
    dealt = df.repartitionByRange(n_ranges, *cols) if n_ranges else df.repartitionByRange(*cols)
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def exclusive_prefix_sums(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                          n_ranges: int | None = None) -> DataFrame:
    """For every row add ``<v>_before`` = sum of ``v`` over all rows that come
    strictly earlier in ``order_cols`` order (any sortable types).  Rows need
    a total order for the result to be deterministic.  All columns of ``df``
    travel through the sort: pass keys and values only and join the rest back."""
    dealt = ranged(df, order_cols, n_ranges)
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # one row for each range
    wr = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(wr), F.lit(0)).alias(f"_o_{v}")
                                        for v in value_cols])
    wi = (Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
          .rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.join(offsets, "_range")
    for v in value_cols:
        out = out.withColumn(f"{v}_before", F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(wi), F.lit(0)))
    return out.drop("_range", *[f"_o_{v}" for v in value_cols])


def grouped_exclusive_prefix(df: DataFrame, order_cols: Sequence[str], value_col: str,
                             group_cols: Sequence[str], out: str, n_ranges: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` inside each group, computed as
    a global running sum in (group, order) order minus the group's starting
    value.  Unlike a partitioned window this splits a hot group across many
    tasks."""
    g = cut_lineage(exclusive_prefix_sums(df, [*group_cols, *order_cols], [value_col], n_ranges))
    before = f"{value_col}_before"
    starts = g.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group_cols]).agg(F.min(before).alias("_gstart"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]
    return (g.join(starts, same).withColumn(out, F.col(before) - F.col("_gstart"))
            .drop(before, "_gstart", *[f"_g_{c}" for c in group_cols]))
