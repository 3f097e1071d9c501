"""Schema-item pruning on long tables.

``table_scores(task_id, table_pos, prob)`` and
``column_scores(task_id, table_pos, col_pos, prob)`` (or the same with
labels) are ranked per task / per table; the kept items are regrouped into
arrays ordered by rank.  Every per-group rank is a ``row_number`` with a
literal limit, which Spark turns into ``WindowGroupLimit`` on both sides of
the shuffle, so a hot task is cut to k rows per map task before it moves.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import grouped_exclusive_prefix


def topk_per_group(df: DataFrame, group: Sequence[str], score: str, pos: str, k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Stable descending argsort, first k: order by score desc
    (NULL last), position asc."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(pos).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def prune_eval(table_scores: DataFrame, column_scores: DataFrame, k_tables: int, k_columns: int,
               task: str = "task_id", table: str = "table_pos", col: str = "col_pos",
               score: str = "prob") -> tuple[DataFrame, DataFrame]:
    """Eval-mode pruning: top tables per task, then top columns per kept
    table.  Returns (kept tables with ``table_rank``, kept columns with
    ``col_rank``)."""
    tables = topk_per_group(table_scores, [task], score, table, k_tables, "table_rank")
    cols = column_scores.join(tables.select(task, table, "table_rank"), [task, table], "left_semi")
    cols = topk_per_group(cols, [task, table], score, col, k_columns, "col_rank")
    return tables, cols


def seeded_key(seed: int | str, *parts: str | Column) -> Column:
    """Reproducible pseudo-random sort key md5('<seed>:<parts>'); DuckDB's
    md5 of the same text gives the same order."""
    cols = [F.lit(f"{seed}")]
    for p in parts:
        cols += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*cols))


def label_topup_sample(items: DataFrame, group: Sequence[str], item: str, label: str, k: int,
                       seed: int = 42, order_col: str = "order") -> DataFrame:
    """L1 + L2: keep every positive item of a group (even more than k), top it
    up to k with negatives picked by a seeded hash, then give the kept items
    a seeded shuffled order ``order_col`` (1-based).  One window ranks
    the positives before the negatives; rows with a null label go."""
    group = list(group)
    positive = F.col(label).cast("int") == 1
    known = items.where(F.col(label).cast("int").isin(0, 1))
    pick = Window.partitionBy(*group).orderBy((~positive).cast("int"), seeded_key(seed, *group, item), F.col(item))
    ranked = known.withColumn("_r", F.row_number().over(pick))  # positives first: a negative's rank counts them
    kept = ranked.where(positive | (F.col("_r") <= F.lit(k))).drop("_r")
    w2 = Window.partitionBy(*group).orderBy(seeded_key(f"{seed}s", *group, item), F.col(item))
    return kept.withColumn(order_col, F.row_number().over(w2))


def regroup(kept: DataFrame, group: Sequence[str], order: str, fields: Sequence[str],
            out: str) -> DataFrame:
    """Fold kept rows back into one array per group, ordered by
    ``order`` (the rank).  Groups hold at most k rows after pruning."""
    st = F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields])
    arr = F.array_sort(F.collect_list(st))
    return kept.groupBy(*group).agg(F.transform(arr, lambda x: x.dropFields("_o")).alias(out))


def prefix_offsets(counts: DataFrame, group: Sequence[str], order: str, count: str,
                   out: str = "offset") -> DataFrame:
    """Exclusive running sum of per-table column counts inside a task
    (a partitioned window: one task's tables are few)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)))


def decorate_name(name: str | Column, comment: str | Column) -> Column:
    """``name ( comment ) `` (trailing blank kept) when a comment exists."""
    n = F.col(name) if isinstance(name, str) else name
    c = F.col(comment) if isinstance(comment, str) else comment
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(n, F.lit(" ( "), c, F.lit(" ) "))).otherwise(n)


def filter_foreign_keys(fks: DataFrame, kept_tables: DataFrame, task: str = "task_id") -> DataFrame:
    """Keep a foreign key only when both of its tables survived.
    ``kept_tables(task_id, table_name)``; two semi joins."""
    src = kept_tables.select(task, F.col("table_name").alias("src_table"))
    dst = kept_tables.select(task, F.col("table_name").alias("dst_table"))
    return fks.join(src, [task, "src_table"], "left_semi").join(dst, [task, "dst_table"], "left_semi")


def filter_matched_contents(matched: DataFrame, kept_columns: DataFrame, task: str = "task_id") -> DataFrame:
    """J6 on the long form ``matched(task_id, key 'table.column', values)``:
    keep entries whose table.column survived (semi join)."""
    keys = kept_columns.select(task, F.concat_ws(".", "table_name", "column_name").alias("key"))
    return matched.join(keys, [task, "key"], "left_semi")


def filter_matched_map(map_col: str, kept_keys: str) -> Column:
    """J6 inside one row: ``map_filter`` by an array of kept keys."""
    return F.map_filter(F.col(map_col), lambda k, v: F.array_contains(F.col(kept_keys), k))


def merge_chunk_scores(tables: DataFrame, chunk_tables: DataFrame, chunk_columns: DataFrame,
                       task: str = "task_id", table: str = "table_pos") -> DataFrame:
    """Table score = max over the chunks it appeared in (0 if in none);
    column scores concatenated in chunk order, then column order.

    ``tables(task_id, table_pos)``; ``chunk_tables(task_id, chunk_pos,
    table_pos, prob)``; ``chunk_columns(task_id, chunk_pos, table_pos,
    col_pos, prob)``."""
    tp = chunk_tables.groupBy(task, table).agg(F.max("prob").alias("table_prob"))
    cp = (chunk_columns.groupBy(task, table)
          .agg(F.array_sort(F.collect_list(F.struct("chunk_pos", "col_pos", "prob"))).alias("_c")))
    return (tables.join(tp, [task, table], "left").join(cp, [task, table], "left")
            .select(task, table, F.coalesce("table_prob", F.lit(0.0)).alias("table_prob"),
                    F.coalesce(F.transform("_c", lambda x: x["prob"]), F.array().cast("array<double>"))
                    .alias("column_probs")))


# ---------------------------------------------------------------------------
# Length-budgeted chunks (W5), scoring plug point (F3), name -> token
# alignment
# ---------------------------------------------------------------------------

LONG_TASK = 10_000  # items; a task of more is cut over many tasks
BAND = 64           # budgets of text length in a band


def piece_count(word: str | Column, width: int = 4) -> Column:
    """Default token count of one word: pieces of at most ``width`` characters
    per whitespace-free run (a stand-in for a subword tokenizer)."""
    w = F.col(word) if isinstance(word, str) else word
    return F.size(F.regexp_extract_all(w, F.lit(r"(\S{1,%d})" % width), 1))


def budget_chunks(items: DataFrame, texts: DataFrame, budget: int = 500, task: str = "task_id",
                  table: str = "table_pos", col: str = "col_pos", table_name: str = "table_name",
                  column_name: str = "column_name", text: str = "text", length=piece_count) -> DataFrame:
    """Cut each task's (table, column) items, in schema order, into
    chunks whose linearised length (2 specials + text + ``| table :`` +
    columns joined by ``,``) stays below ``budget``: an item joins the current
    chunk when the length including it is < budget, else it opens a new chunk.
    Names are the decorated ones the caller passes.  An empty leading chunk
    (first item alone too long) is not emitted.  Returns items + chunk_pos.

    A task's items are folded in order by an ``aggregate``.  Tasks of more than
    ``LONG_TASK`` items go over many tasks instead, see ``long_chunks``."""
    base = texts.select(task, (F.lit(2) + length(F.col(text))).alias("_base"))
    it = items.select(task, table, col, length(F.col(table_name)).alias("_tl"),
                      length(F.col(column_name)).alias("_cl"))
    long = it.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_TASK).select(task)
    chunks = None
    if not long.isEmpty():
        placed = it.join(long, task).join(base, task).toDF("task", "table", "col", "tl", "cl", "base")
        chunks = long_chunks(placed, budget).toDF(task, table, col, "chunk_pos")
        it = it.join(long, task, "left_anti")
    per_task = (it.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(table, col, "_tl", "_cl"))).alias("_it"))
                .join(base, task))
    init = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.col("_base").cast("int").alias("len"),
                    F.lit(None).cast("long").alias("cur"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        same = acc["cur"].isNotNull() & (acc["cur"] == x[table].cast("long"))
        inc = F.when(same, x["_cl"] + 1).otherwise(x["_tl"] + 2 + x["_cl"])
        fits = (acc["len"] + inc) < budget
        fresh = F.col("_base") + x["_tl"] + 2 + x["_cl"]
        new_chunk = F.when(fits | (acc["n"] == 0), acc["chunk"]).otherwise(acc["chunk"] + 1)
        new_len = F.when(fits, acc["len"] + inc).when(acc["n"] == 0, fresh).otherwise(fresh)
        new_n = F.when(fits | (acc["n"] == 0), acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(new_chunk.alias("chunk"), new_n.cast("int").alias("n"), new_len.cast("int").alias("len"),
                        x[table].cast("long").alias("cur"), F.concat(acc["out"], F.array(new_chunk)).alias("out"))
    folded = per_task.select(task, "_it", F.aggregate("_it", init, step, lambda a: a["out"]).alias("_ch"))
    z = folded.select(task, F.explode(F.arrays_zip("_it", "_ch")).alias("z"))
    short = z.select(task, F.col(f"z._it.{table}").alias(table), F.col(f"z._it.{col}").alias(col),
                     F.col("z._ch").alias("chunk_pos"))
    return short if chunks is None else short.unionByName(chunks)


def long_chunks(items: DataFrame, budget: int) -> DataFrame:
    """(task, table, col, chunk_pos) for the items (task, table, col, tl, cl, base) of long
    tasks, as ``budget_chunks`` cuts them, without an order that one task has to follow.

    With the running sum P of the items' lengths (``tl`` only where a table begins), the
    chunk that begins at item i ends before the first later item whose P reaches a limit
    known from i alone.  So every item has a successor, found in bands of P; of the
    chain of successors from a task's first item the chunk starts are marked by
    doubling: after round k the first 2**k ones are known and every link is 2**k long.
    A last running sum counts the starts up to each item.  P names an item: it grows
    by 1 or more."""
    firsts = items.groupBy("task", "table").agg(F.min("col").alias("first"))
    sized = items.join(firsts, ["task", "table"]).withColumn("fresh", F.col("tl") + 2 + F.col("cl")) \
        .withColumn("size", F.when(F.col("col") == F.col("first"), F.col("fresh")).otherwise(F.col("cl") + 1).cast("long"))
    summed = grouped_exclusive_prefix(sized, ["table", "col"], "size", ["task"], "before").withColumn("p", F.col("before") + F.col("size"))
    placed = cut_lineage(summed.select("task", "table", "col", "p", F.greatest(F.lit(budget) - F.col("base") - F.col("fresh") + F.col("p"),
                                                                              F.col("p") + 1).alias("limit")))
    band = lambda c: F.floor(F.col(c) / (BAND * budget)).alias("band")
    points = placed.select("task", band("p"), F.col("p").alias("v"), F.lit(None).cast("long").alias("at"), F.lit(1).alias("kind"))
    wanted = placed.select("task", band("limit"), F.col("limit").alias("v"), F.col("p").alias("at"), F.lit(0).alias("kind"))
    rows = points.unionByName(wanted)
    point = F.when(F.col("kind") == 1, F.col("v"))
    onward = Window.partitionBy("task", "band").orderBy("v", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inside = rows.withColumn("next", F.first(point, ignorenulls=True).over(onward)).where("kind = 0")
    later = Window.partitionBy("task").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    bands = rows.groupBy("task", "band").agg(F.min(point).alias("low")).withColumn("beyond", F.first("low", ignorenulls=True).over(later))
    links = inside.join(bands.select("task", "band", "beyond"), ["task", "band"]).select("task", "at", F.coalesce("next", "beyond").alias("next"))
    jump = cut_lineage(links.where("next IS NOT NULL"))
    starts = cut_lineage(placed.groupBy("task").agg(F.min("p").alias("at")))
    while True:
        found = cut_lineage(starts.join(jump, ["task", "at"]).select("task", F.col("next").alias("at")))
        if found.isEmpty():
            break
        starts = cut_lineage(starts.unionByName(found))
        ahead = jump.select("task", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = cut_lineage(jump.join(ahead, ["task", "next"]).select("task", "at", F.col("after").alias("next")))
    marked = placed.join(starts.select("task", F.col("at").alias("p"), F.lit(1).alias("starts")), ["task", "p"], "left") \
        .select("task", "table", "col", F.coalesce("starts", F.lit(0)).cast("long").alias("starts"))
    counted = grouped_exclusive_prefix(marked, ["table", "col"], "starts", ["task"], "before")
    return counted.select("task", "table", "col", (F.col("before") + F.col("starts") - 1).cast("int").alias("chunk_pos"))


def score_schema_items(chunked: DataFrame, texts: DataFrame, scorer=None, task: str = "task_id",
                       name: str = "name", text: str = "text", out_schema: str | None = None) -> DataFrame:
    """scores for (task, chunk, table, column) items.  Default: the share
    of a name's words that occur in the task text (JVM).  A model scorer is a
    pandas function given to ``mapInPandas`` (batches of items with their
    text) returning rows of ``out_schema``."""
    if scorer is not None:
        return chunked.join(texts.select(task, F.col(text).alias("_text")), task).mapInPandas(scorer, out_schema)

    def word_set(c):
        return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "),
                                         lambda w: w != ""))
    # the text's words once per task, not once per schema item
    j = chunked.join(texts.select(task, word_set(F.col(text)).alias("_tw")), task)
    words = word_set(F.col(name))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.col("_tw"))) / F.size(words)).otherwise(0.0)
    return j.withColumn("prob", share.cast("double")).drop("_tw")


def name_token_spans(texts: DataFrame, tables: DataFrame, columns: DataFrame, max_length: int = 512,
                     task: str = "task_id", table: str = "table_pos", col: str = "col_pos",
                     length=piece_count) -> DataFrame:
    """P16 + J8: linearise ``[text, |, table, :, col, ',', col, ...]`` per task,
    give each word its token positions (position 0 is the leading special
    token, truncation keeps positions < max_length - 1), and return every
    table/column name that keeps at least one token:
    (task, table_pos, col_pos (-1 for the table name), first_token, n_tokens).

    ``tables(task, table_pos, table_name)``, ``columns(task, table_pos,
    col_pos, column_name)``.  Offsets come from a grouped prefix sum that is
    split by ranges, not a window per task."""
    ncols = columns.groupBy(task, table).agg(F.max(col).alias("_last"))
    t = tables.join(ncols, [task, table], "left")
    words = (
        texts.select(task, F.lit(-1).cast("long").alias(table), F.lit(0).cast("long").alias("_slot"),
                     F.lit(None).cast("long").alias(col), length(F.col("text")).alias("_n"))
        .unionByName(t.select(task, F.col(table).cast("long").alias(table), F.lit(-3).cast("long").alias("_slot"),
                              F.lit(None).cast("long").alias(col), F.lit(1).alias("_n")))
        .unionByName(t.select(task, F.col(table).cast("long").alias(table), F.lit(-2).cast("long").alias("_slot"),
                              F.lit(-1).cast("long").alias(col), length(F.col("table_name")).alias("_n")))
        .unionByName(t.where(F.col("_last").isNotNull())
                     .select(task, F.col(table).cast("long").alias(table), F.lit(-1).cast("long").alias("_slot"),
                             F.lit(None).cast("long").alias(col), F.lit(1).alias("_n")))
        .unionByName(columns.select(task, F.col(table).cast("long").alias(table),
                                    (F.col(col) * 2).cast("long").alias("_slot"), F.col(col).cast("long").alias(col),
                                    length(F.col("column_name")).alias("_n")))
        .unionByName(columns.join(ncols, [task, table]).where(F.col(col) < F.col("_last"))
                     .select(task, F.col(table).cast("long").alias(table),
                             (F.col(col) * 2 + 1).cast("long").alias("_slot"),
                             F.lit(None).cast("long").alias(col), F.lit(1).alias("_n"))))
    off = grouped_exclusive_prefix(words, [table, "_slot"], "_n", [task], "_before")
    first = F.col("_before") + 1
    kept = F.greatest(F.least(F.col("_n"), F.lit(max_length - 1) - first), F.lit(0))
    return (off.where(F.col(col).isNotNull())
            .select(task, table, col, first.cast("long").alias("first_token"), kept.cast("int").alias("n_tokens"))
            .where(F.col("n_tokens") > 0))


def realign_counts(spans: DataFrame, task: str = "task_id", table: str = "table_pos",
                   col: str = "col_pos") -> DataFrame:
    """Per table the number of columns that still have tokens after
    truncation (recounted from the surviving spans)."""
    return (spans.where(F.col(col) >= 0).groupBy(task, table)
            .agg(F.count(F.lit(1)).cast("int").alias("n_columns")))
