"""Choosing one generated candidate per task (W7) and aligning predictions
with their tasks (J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed value: the text used when no candidate ran and the first one is blank.
PLACEHOLDER = "PLSQL placeholder"


def first_valid_candidate(cands: DataFrame, task: str = "task_id", pos: str = "cand_pos",
                          code: str = "code", error: str = "error") -> DataFrame:
    """Per task: the first candidate (beam order) that ran without error;
    else the first candidate when it is not blank; else the placeholder.
    ``min_by`` is a partial aggregate, so a task with many candidates is
    combined map-side.  Returns (task, chosen_pos, code, no_error)."""
    ok = F.col(error).isNull()
    agg = cands.groupBy(task).agg(
        F.min(F.when(ok, F.col(pos))).alias("_ok_pos"),
        F.min_by(F.col(code), F.when(ok, F.col(pos))).alias("_ok_code"),
        F.min(F.col(pos)).alias("_first_pos"),
        F.min_by(F.col(code), F.col(pos)).alias("_first_code"))
    first_usable = strip(F.coalesce(F.col("_first_code"), F.lit(""))) != ""
    return agg.select(
        task,
        F.when(F.col("_ok_pos").isNotNull(), F.col("_ok_pos"))
         .when(first_usable, F.col("_first_pos")).alias("chosen_pos"),
        F.when(F.col("_ok_pos").isNotNull(), F.col("_ok_code"))
         .when(first_usable, F.col("_first_code")).otherwise(F.lit(PLACEHOLDER)).alias(code),
        F.col("_ok_pos").isNotNull().cast("int").alias("no_error"))


def align(left: DataFrame, right: DataFrame, key: str = "task_id") -> DataFrame:
    """Positional zip of the reference becomes an equi join on an
    explicit key; equal key sets are asserted by one anti-join count."""
    missing = left.join(right, key, "left_anti").limit(1).count() + \
        right.join(left, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"align: key sets of the two sides differ on {key}")
    return left.join(right, key)
