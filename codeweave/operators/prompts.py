"""Schema serialisation (P3), prompts (P4, P5, P6), input truncation
and supervised examples (P15), all as column expressions or joins."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import INSTRUCTION_LINE, SKELETON_LABEL, col, cot_hint, strip

IGNORE_INDEX = -100


def schema_sequence(schema: str | Column) -> Column:
    """``database schema :`` then one line per table
    ``table T , columns = [ c ( type | primary key | comment : x | values : a , b ) , ... ]``
    then the foreign keys (``a.b = c.d`` per line) or ``foreign keys : None``;
    the whole text stripped.  Table comments are not printed."""
    s = col(schema)

    def column_text(c):
        parts = F.array(
            c["t"],
            F.when(c["pk"] != 0, F.lit("primary key")),
            F.when(c["cm"] != "", F.concat(F.lit("comment : "), c["cm"])),
            F.when(F.size(c["v"]) > 0, F.concat(F.lit("values : "), F.array_join(c["v"], " , "))))
        return F.concat(c["n"], F.lit(" ( "), F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | "),
                        F.lit(" )"))

    def table_text(t):
        zipped = F.arrays_zip(t["column_names"].alias("n"), t["column_types"].alias("t"),
                              t["column_comments"].alias("cm"), t["column_contents"].alias("v"),
                              t["pk_indicators"].alias("pk"))
        cols = F.array_join(F.transform(zipped, column_text), " , ")
        return F.concat(F.lit("table "), t["table_name"], F.lit(" , columns = [ "), cols, F.lit(" ]\n"))

    tables = F.array_join(F.transform(s["schema_items"], table_text), "")
    fks = s["foreign_keys"]
    fk_text = F.when(F.size(fks) > 0, F.concat(
        F.lit("foreign keys :\n"),
        F.array_join(F.transform(fks, lambda f: F.concat(f[0], F.lit("."), f[1], F.lit(" = "), f[2], F.lit("."),
                                                           f[3], F.lit("\n"))), ""))
    ).otherwise(F.lit("foreign keys : None\n"))
    return strip(F.concat(F.lit("database schema :\n"), tables, fk_text))


def zero_shot_prompt(text: str | Column, schema_seq: str | Column, skeleton: str | Column | None = None,
                     cot: bool = False) -> Column:
    """[hint] schema, [Skeleton: ...], question, fixed instruction line."""
    parts = []
    if cot:
        parts += [cot_hint(text), F.lit("\n")]
    parts += [col(schema_seq), F.lit("\n")]
    if skeleton is not None:
        parts += [F.lit(SKELETON_LABEL), col(skeleton), F.lit("\n")]
    parts += [col(text), F.lit("\n"), F.lit(INSTRUCTION_LINE + "\n")]
    return F.concat(*parts)


def few_shot_prompts(tasks: DataFrame, topk: DataFrame, demos: DataFrame, *, task_id: str = "eval_id",
                     demo_id: str = "demo_id", text: str = "text", schema_seq: str = "schema_sequence",
                     demo_text: str = "text", demo_code: str = "plsql", skeleton: str | None = None,
                     cot: bool = False, out: str = "prompt") -> DataFrame:
    """P5 + J4: per task the k demonstrations in rank order, each as text,
    newline, code, blank line; then schema, [Skeleton: ...], question.  No
    instruction line (as in the reference's few-shot prompts).

    ``topk(eval_id, rank, demo_id)``; demo texts are looked up with a join
    that is broadcast only when the demo table is estimated small."""
    d = demos.select(F.col(demo_id).alias(demo_id), F.col(demo_text).alias("_dt"), F.col(demo_code).alias("_dc"))
    shots = (topk.select(task_id, "rank", demo_id).join(d, demo_id)
             .groupBy(task_id)
             .agg(F.array_sort(F.collect_list(F.struct("rank", "_dt", "_dc"))).alias("_shots")))
    block = F.array_join(F.transform("_shots", lambda s: F.concat(s["_dt"], F.lit("\n"), s["_dc"], F.lit("\n\n"))), "")
    parts = []
    if cot:
        parts += [cot_hint(text), F.lit("\n")]
    parts += [F.coalesce(block, F.lit("")), F.col(schema_seq), F.lit("\n")]
    if skeleton is not None:
        parts += [F.lit(SKELETON_LABEL), F.col(skeleton), F.lit("\n")]
    parts += [F.col(text), F.lit("\n")]
    return tasks.join(shots, task_id, "left").withColumn(out, F.concat(*parts)).drop("_shots")


def truncate_left(ids: str | Column, max_len: int, bos: Sequence[int] = (1,), always_bos: bool = False) -> Column:
    """When longer than ``max_len`` keep the BOS ids plus the last
    ``max_len - len(bos)`` ids.  ``always_bos`` prepends BOS first (zero-shot
    path); without it BOS only comes with truncation (few-shot path)."""
    x = col(ids)
    b = F.array(*[F.lit(int(v)) for v in bos])
    if always_bos:
        x = F.concat(b, x)
    keep = max_len - len(bos)
    return F.when(F.size(x) > max_len, F.concat(b, F.slice(x, -keep, keep))).otherwise(x)


def attention_mask(ids: str | Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(col(ids)))


def sft_example(prefix_ids: str | Column, target_ids: str | Column, max_tokens: int,
                bos: int, eos: int, pad: int) -> Column:
    """struct(input_ids, attention_mask, labels).  Fits: prefix+target
    padded right, labels -100 except the target.  Too long: BOS + the last
    max-1 ids, labels the last max of (-100 * prefix + target)."""
    p = F.concat(F.array(F.lit(bos)), col(prefix_ids))
    t = F.concat(col(target_ids), F.array(F.lit(eos)))
    n = F.size(p) + F.size(t)
    pad_n = F.greatest(F.lit(max_tokens) - n, F.lit(0))
    ign_p = F.array_repeat(F.lit(IGNORE_INDEX), F.size(p))
    fit = F.struct(
        F.concat(p, t, F.array_repeat(F.lit(pad), pad_n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad_n)).alias("attention_mask"),
        F.concat(ign_p, t, F.array_repeat(F.lit(IGNORE_INDEX), pad_n)).alias("labels"))
    keep = max_tokens - 1
    both = F.concat(p, t)
    lab = F.concat(ign_p, t)
    cut = F.struct(
        F.concat(F.array(F.lit(bos)), F.slice(both, -keep, keep)).alias("input_ids"),
        F.array_repeat(F.lit(1), F.lit(max_tokens)).alias("attention_mask"),
        F.slice(lab, -max_tokens, max_tokens).alias("labels"))
    return F.when(n <= max_tokens, fit).otherwise(cut)
