"""Mixing sources to target weights by systematic sampling.

Targets share the words of all documents by source weight; a target stops at
``max_repeats`` times its source's words and the excess goes to the others by
weight.  Within a source every document expects target / words copies.  The
expected copies are summed up along a fixed order (by size, so that a draw spreads
over all sizes; then by a hash), one random offset is added, and a document is
emitted once for each integer its interval crosses.  Of evenly spaced offsets after
a random start a source takes the one that brings its words nearest to its target,
which matters where one document is a large part of a small source.

The order within a source is cut into cells (size band, first digit of the hash);
a cell's start is the sum of the cells before it, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import renamed

BANDS = 16    # size bands for each doubling of the size
OFFSETS = 32  # evenly spaced offsets, after a random start, of which a source takes one
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row for each source.

    Sources by code point, null last, take ``weights`` in turn.  In the order of
    size / weight, a source is held at its limit while its share of what the ones
    before leave is above the limit; the rest share by weight."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))) \
                        .withColumn("most", F.lit(max_repeats) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = weighted.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) \
                   .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
                   .withColumn("full", F.col("most") * F.col("heavy") <= F.col("left") * F.col("weight"))
    free = rest.withColumn("free_left", F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)) \
               .withColumn("free_heavy", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    share = F.col("weight") * (F.col("free_left").cast("double") / F.col("free_heavy"))
    return free.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _placed(docs: DataFrame, weights: list[int], max_repeats: int, key: str, text: str, source: str, seed: str) -> tuple[DataFrame, list[Column]]:
    """The renamed rows with a struct ``mix``, and the columns that give ``docs`` back."""
    rows, (key, text, source), back = renamed(docs, key, text, source)
    sized = rows.withColumn("size", n_words(F.col(text)))
    targets = source_targets(sized.select(F.col(source).alias("source"), "size"), weights, max_repeats) \
        .select(F.col("source").alias("t_source"), F.col("source_size").alias("t_size"), F.col("target").alias("t_target"))
    marked = sized.withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))) \
                  .withColumn("band", F.floor(F.log2(F.col("size") + 1) * BANDS)).withColumn("digit", F.substring("hash", 1, 1))
    cell = [F.col(source), F.col("band"), F.col("digit")]
    counts = marked.groupBy(cell[0].alias("c_source"), cell[1].alias("c_band"), cell[2].alias("c_digit")).agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("c_source").orderBy("c_band", "c_digit").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("begins", F.coalesce(F.sum("n").over(along), F.lit(0))) \
                   .join(targets, F.col("c_source").eqNullSafe(F.col("t_source"))).drop("t_source", "n")
    inside = W.partitionBy(*cell).orderBy("size", "hash", key)
    ranked = marked.withColumn("rank", F.row_number().over(inside)) \
                   .join(starts, cell[0].eqNullSafe(F.col("c_source")) & (cell[1] == F.col("c_band")) & (cell[2] == F.col("c_digit")))
    placed = ranked.withColumn("rank", F.col("begins") + F.col("rank"))
    each = F.when(F.col("t_size") > 0, F.col("t_target") / F.col("t_size")).otherwise(F.lit(0.0))
    upto = lambda rank, offset: F.floor(rank * each + offset)
    copies = lambda offset: F.least(upto(F.col("rank"), offset) - upto(F.col("rank") - 1, offset), F.lit(max_repeats)).cast("long")
    begin = uniform(F.concat(F.lit(f"{seed}:offset:"), F.coalesce(F.col(source).cast("string"), F.lit(""))))
    away = lambda j: F.abs(F.sum(F.col("size") * copies(begin + j / OFFSETS)) - F.max("t_target"))
    nearest = F.array_min(F.array(*(F.struct(away(j).alias("away"), F.lit(j).alias("j")) for j in range(OFFSETS))))
    offsets = placed.groupBy(F.col(source).alias("o_source")).agg(nearest["j"].alias("j"))
    taken = placed.join(offsets, F.col(source).eqNullSafe(F.col("o_source")))
    own = F.struct("size", F.col("t_size").alias("source_size"), F.col("t_target").alias("target"), copies(begin + F.col("j") / OFFSETS).alias("copies"))
    return taken.withColumn("mix", own), back


def mix(docs: DataFrame, weights: list[int], max_repeats: int = 3, key: str = "doc_id", text: str = "text",
        source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``_mix`` (size, source_size, target, copies):
    how often the mix takes each row; reruns agree.

    Null texts and texts without words have size 0; null is a source of its own.
    Rows that agree in key and size are interchangeable.  An empty table gives an
    empty one.  No column of ``docs`` is read but the three named; one called
    ``_mix`` is replaced.
    """
    taken, back = _placed(docs, weights, max_repeats, key, text, source, seed)
    return taken.select(*(b for b, c in zip(back, docs.columns) if c.lower() != "_mix"), F.col("mix").alias("_mix"))


def mixed(docs: DataFrame, weights: list[int], max_repeats: int = 3, key: str = "doc_id", text: str = "text",
          source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    taken, back = _placed(docs, weights, max_repeats, key, text, source, seed)
    return taken.where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select(*back)
