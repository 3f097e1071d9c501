"""Reports: evaluation accuracy (A4/A5), exact AUC (A6), coverage@k
and list containment (U3).  All are partial aggregates (map-side combine),
so a hot group never lands whole in one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import exclusive_prefix_sums

REPORTED_FLAGS = ("insert", "update", "delete", "if", "loop")  # select/declare are not reported


def evaluation_report(df: DataFrame, *, ex: str, em: str, no_error: str | None = None,
                      flags: Sequence[str] = REPORTED_FLAGS, seconds: str | None = None) -> DataFrame:
    """One row: N, no-error count, EX = accurate/N, EM = exact/N, per-flag
    accuracy sum(flag*accurate)/max(sum(flag),1), and total/mean seconds."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n"),
            F.sum(F.col(ex).cast("long")).cast("long").alias("accurate"),
            F.sum(F.col(em).cast("long")).cast("long").alias("exact"),
            (F.sum(F.col(ex).cast("double")) / F.count(F.lit(1))).alias("ex"),
            (F.sum(F.col(em).cast("double")) / F.count(F.lit(1))).alias("em")]
    if no_error:
        aggs.append(F.sum(F.col(no_error).cast("long")).cast("long").alias("no_error"))
    for f in flags:
        total = F.sum(F.col(f).cast("long"))
        hit = F.sum((F.col(f).cast("long") * F.col(ex).cast("long")))
        aggs.append((hit / F.greatest(total, F.lit(1))).cast("double").alias(f"{f}_acc"))
        aggs.append(total.cast("long").alias(f"{f}_total"))
    if seconds:
        aggs += [F.sum(seconds).cast("double").alias("total_seconds"),
                 F.avg(seconds).cast("double").alias("mean_seconds")]
    return df.agg(*aggs)


def auc(df: DataFrame, label: str, score: str) -> Column | DataFrame:
    """Exact ROC AUC (Mann-Whitney U with mid-ranks for tied scores).

    Rows are first reduced to one row per distinct score (positives, count);
    the rank of a score is the number of rows with a smaller score plus the
    middle of its own tie block, via the range-parallel prefix sum."""
    g = (df.where(F.col(score).isNotNull())
         .groupBy(F.col(score).cast("double").alias("_s"))
         .agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c")))
    ranked = exclusive_prefix_sums(g, ["_s"], ["_c"])
    mid = F.col("_c_before") + (F.col("_c") + F.lit(1)) / F.lit(2.0)
    agg = ranked.agg(F.sum(F.col("_p") * mid).alias("rs"), F.sum("_p").alias("p"),
                     F.sum(F.col("_c") - F.col("_p")).alias("n"))
    u = F.col("rs") - F.col("p") * (F.col("p") + F.lit(1)) / F.lit(2.0)
    return agg.select(F.when((F.col("p") > 0) & (F.col("n") > 0),
                             u / (F.col("p") * F.col("n"))).cast("double").alias("auc"))


def coverage_at_k(items: DataFrame, *, group: Sequence[str], score: str, pos: str, label: str,
                  max_k: int = 100, only_with_positives: bool = False) -> DataFrame:
    """For k = 1..max_k the number of groups whose positives all sit in
    the top k by (score desc, pos asc), and the number of groups counted
    (every group, or only those with a positive).

    The rank of a group's worst positive equals the number of its items that
    sort at or before it.  Two partial aggregations over the items find it
    (no per-group sort): the worst positive per group (NULL without one),
    then the count after joining it back."""
    group = list(group)
    flag = F.col(label).cast("boolean")
    items = items.withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))  # no score ranks last
    worst = items.groupBy(*group).agg(
        F.min(F.when(flag, F.struct(F.col(score).alias("ws"), (-F.col(pos)).alias("wp")))).alias("w"))
    if only_with_positives:
        worst = worst.where(F.col("w").isNotNull())
    at_or_before = ((F.col(score) > F.col("w.ws")) |
                    ((F.col(score) == F.col("w.ws")) & (F.col(pos) <= -F.col("w.wp"))))
    need = (items.join(worst, group)
            .groupBy(*group).agg(F.sum(F.when(F.col("w").isNull(), F.lit(0))
                                       .otherwise(at_or_before.cast("long"))).alias("need")))
    hist = need.groupBy("need").agg(F.count(F.lit(1)).alias("n"))
    total = hist.agg(F.sum("n")).first()[0] or 0  # one number reaches the driver
    ks = F.when(F.col("need") <= max_k, F.sequence(F.greatest(F.col("need"), F.lit(1)).cast("int"),
                                                   F.lit(max_k))).otherwise(F.array().cast("array<int>"))
    covered = (hist.select(F.explode(ks).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("covered")))
    spark = items.sparkSession
    return (spark.range(1, max_k + 1).select(F.col("id").cast("int").alias("k"))
            .join(covered, "k", "left")
            .select("k", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
                    F.lit(total).cast("long").alias("total")))


def contains_all(a: str | Column, b: str | Column) -> Column:
    """1 when every element of b occurs in a."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (F.size(F.array_except(b, a)) == 0).cast("int")
