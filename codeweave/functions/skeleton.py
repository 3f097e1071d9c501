"""Skeletons: question skeletons by masking tagged words (P7), block trees
of code skeletons (P13) and the tree edit distance as an Arrow UDF (F4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .text import col
from .trees import Tree, tree_edit_distance

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
MASKED_TAGS = ["NN", "NNP", "NNS", "NNPS", "CD", "SYM", "FW", "IN"]
DROPPED_TOKENS = ["$", "''", "(", ")", ",", "--", ".", ":"]
BLOCK_OPENERS = ["BEGIN", "DECLARE", "LOOP", "IF"]

# word_tokenize-like split: possessive 's, words/numbers (with inner dots),
# double dash, '' quotes, any other single symbol
QUESTION_TOKEN = r"('s|''|--|[\p{L}\p{N}_]+(?:\.[\p{N}]+)?|[^\p{L}\p{N}_\s])"
# code skeleton tokens: END [IF|LOOP|CASE] as one token, words, symbols
SKELETON_TOKEN = r"((?i:END(?:\s+(?:IF|LOOP|CASE))?)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"


def question_skeleton(df: DataFrame, text: str, lexicon: DataFrame, out: str = "question_skeleton",
                      *, key: str) -> DataFrame:
    """Tokens tagged by a caller-given ``lexicon(word, tag)`` (numbers
    are tagged CD by rule); masked tags become ``_``, listed punctuation is
    dropped, the rest is kept; joined by blanks, ``'s`` repaired, runs of
    ``_`` collapsed and a leading ``_ `` removed.  A word listed twice takes
    its smallest tag.  The POS model of the reference is not built.

    Rows of one key are merged by position.  The texts stay where they are: only a
    batch's distinct tokens join the lexicon (see ``looked_up``)."""
    from ..operators.packing import keys_repeat, looked_up

    lex = lexicon.groupBy(F.col("word").alias("token")).agg(F.min("tag").alias("tag"))
    masked = lex.where(F.col("tag").isin(*MASKED_TAGS)).select("token", F.lit("_").alias("value"))
    shown = (F.when(F.col("token").rlike(r"^\p{N}"), F.lit("_"))
             .when(F.col("token").isin(*DROPPED_TOKENS), F.lit(None)).otherwise(F.col("token")))
    # a number is tagged CD whatever the lexicon says; CD is masked like the rest
    toks = F.regexp_extract_all(F.col(text), F.lit(QUESTION_TOKEN), 1)
    found = looked_up(df.withColumn("_row", F.struct(*df.columns)), "_row", toks, masked, shown)
    repaired = lambda words: F.regexp_replace(F.regexp_replace(F.replace(F.replace(
        F.array_join(words, " "), F.lit("_ 's"), F.lit("_")), F.lit(" 's"), F.lit("'s")), "_( _)+", "_"), "^_ ", "")
    if not keys_repeat(df, key):
        return found.select("_row.*", F.coalesce(repaired(F.col("found")), F.lit("")).alias(out))
    placed = F.filter(F.flatten(F.transform("_l", lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), w.alias("w"))))),
                      lambda x: x["w"].isNotNull())
    res = (found.select(F.col("_row")[key].alias(key), "found").groupBy(key).agg(F.collect_list("found").alias("_l"))
           .select(key, repaired(F.transform(F.array_sort(placed), lambda x: x["w"])).alias(out)))
    return df.join(res, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def skeleton_tree(skeleton: str | Column) -> Column:
    """The block tree of a code skeleton as a preorder
    array<struct<depth:int, value:string>>.  Parts between ``$$`` are
    tokenised; BEGIN/DECLARE/LOOP/IF open a block, any token starting with
    END closes one (never above the root) and adds no node; all other
    tokens are leaves.  Values are upper-cased."""
    parts = F.filter(F.transform(F.split(col(skeleton), r"\$\$"), lambda p: F.trim(p)), lambda p: p != "")
    toks = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(SKELETON_TOKEN), 1)))
    return _preorder(F.transform(toks, lambda t: F.upper(t)))


def clamped_depths(steps: np.ndarray) -> np.ndarray:
    """The depth before each step of +1, 0 or -1 that never goes below zero.  Runs of steps
    compose as (sum, lowest partial sum), so one running sum and one running minimum do:
    the depth is the sum, less its lowest value so far where that is negative."""
    total = np.concatenate([[0], np.cumsum(steps)])
    return (total - np.minimum.accumulate(total))[:-1]


@pandas_udf(ArrayType(StructType([StructField("depth", IntegerType()), StructField("value", StringType())])))
def _preorder(tokens: pd.Series) -> pd.Series:
    def nodes(values):
        if values is None:
            return None
        ends = np.array([v.startswith("END") for v in values], bool)
        opens = np.array([v in BLOCK_OPENERS for v in values], bool)
        depths = clamped_depths(opens.astype(np.int64) - ends)
        return [(d, v) for d, v, end in zip(depths.tolist(), values, ends.tolist()) if not end]

    return pd.Series([nodes(v) for v in tokens], dtype=object)


@pandas_udf(DoubleType())
def tree_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """edit distance of two preorder trees per row (Arrow batches; a null tree
    is the root alone).  Pass tree columns (project ``skeleton_tree`` first), not
    the inline expression."""
    return pd.Series([float(tree_edit_distance(Tree(x), Tree(y))) for x, y in zip(a, b)])
