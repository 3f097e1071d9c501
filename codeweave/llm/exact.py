"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of ``block_chars`` characters.  Equal blocks
get the same integer, different ones different integers: blocks are sorted and
numbered.  Then neighbouring names are paired and the pairs are named in the same
way, level by level, until one name is left for each document.  Two documents
have the same (level, name) exactly when their normalised texts are equal; no
hash decides.

Naming happens in two steps so that a value that fills a third of all rows is
split: ``SPLITS`` parts of the rows number their own distinct values first, then
one row for each part and value takes part in the numbering of all.  The bucket
of a value's hash only deals out the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import kept_table, renamed

BLOCK_CHARS = 2048
BUCKETS = 65_536
SPLITS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """The text with A-Z (only) lower-cased; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def named(rows: DataFrame, values: list[str], place: list[str]) -> DataFrame:
    """``rows`` with the columns ``values`` replaced by one integer ``name``: equal
    values share it, different values never do.  ``place`` are the other columns."""
    whole = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  never null
    dealt = rows.withColumn("_bucket", whole(F.pmod(F.xxhash64(*values), F.lit(BUCKETS)))) \
                .withColumn("_part", whole(F.pmod(F.xxhash64(F.lit(17), *place), F.lit(SPLITS))))
    # every column is part of the order and no join key can be null, so both uses
    # below have the same plan up to the shuffle and read one copy of it
    order = W.partitionBy("_bucket", "_part").orderBy(*values, *place)
    same = reduce(lambda a, b: a & b, (F.lag(v).over(order).eqNullSafe(F.col(v)) for v in values))
    own = dealt.withColumn("_new", F.when(same & (F.row_number().over(order) > 1), 0).otherwise(1)) \
               .withColumn("_own", whole(F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))))
    names = own.where("_new = 1").select(
        "_bucket", "_part", "_own",
        (F.dense_rank().over(W.partitionBy("_bucket").orderBy(*values)).cast("long") * BUCKETS + F.col("_bucket")).alias("name"))
    return own.drop("_new", *values).join(names, ["_bucket", "_part", "_own"]).select(*place, "name")


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, text_sha256, level, name): one row for each key and normalised text;
    (level, name) is equal exactly for equal normalised texts."""
    base = docs.select(F.col(key).alias("key"), normalized(F.col(text)).alias("_text"))
    blocks = F.when(F.col("_text") == "", F.array(F.lit(""))) \
              .otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    cut = base.select("key", F.sha2("_text", 256).alias("text_sha256"), blocks.alias("_blocks")) \
              .select("key", "text_sha256", F.size("_blocks").alias("n"), F.posexplode_outer("_blocks").alias("at", "block"))
    level, current = 0, kept_table(named(cut, ["block"], ["key", "text_sha256", "n", "at"]), "block-names")
    done = []
    while True:
        done.append(current.where("n = 1").select("key", "text_sha256", F.lit(level).alias("level"), "name").distinct())
        longer = current.where("n > 1")
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, done)
        half = F.shiftright("at", 1)
        pairs = longer.groupBy("key", "text_sha256", F.ceil(F.col("n") / 2).cast("int").alias("n"), half.alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right"))
        level, current = level + 1, kept_table(named(pairs, ["left", "right"], ["key", "text_sha256", "n", "at"]), "pair-names")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each input row: key, keep_id (largest key among the rows of equal
    normalised text), group_size (their number), kept (key = keep_id) and
    text_sha256 (of the normalised text, lower-case hex).

    Null texts count as empty.  Rows repeated with the same key and text count one
    by one and are all marked alike.  Null keys are smaller than any other.  Other
    columns are not read, whatever their names.
    """
    found = identities(docs, key, text, block_chars)
    rows = docs.select(F.col(key).alias("key"), F.sha2(normalized(F.col(text)), 256).alias("text_sha256")) \
               .groupBy("key", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    a, b = found.alias("a"), rows.alias("b")
    counted = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))) \
               .select("a.key", "a.text_sha256", "a.level", "a.name", "b.copies")
    groups = counted.groupBy("level", "name").agg(F.max("key").alias("keep_id"), F.sum("copies").alias("group_size"))
    return counted.join(groups, ["level", "name"]) \
        .select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
                "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: for each normalised
    text one row with the largest key."""
    kept = duplicates(docs, key, text).where("kept").select(F.col(key).alias("kept_key"), F.col("text_sha256").alias("kept_sha")).distinct()
    rows, (own, said), back = renamed(docs, key, text)
    marked = rows.withColumn("sha", F.sha2(normalized(F.col(said)), 256))
    return marked.join(kept, F.col(own).eqNullSafe(F.col("kept_key")) & (F.col("sha") == F.col("kept_sha")), "left_semi") \
                 .dropDuplicates([own, "sha"]).select(*back)
