"""End-to-end flows of the reference's scripts, composed from the
operators.  Every step is a lazy DataFrame; the only actions are the size
checks inside retrieval and the final write the caller triggers.

* ``few_shot_inputs``: prune schemas by scores, serialise them, retrieve
  demonstrations by fused question-skeleton / code-skeleton similarity (or
  the larger of text and question-skeleton similarity), assemble the prompts,
  tokenise and left-truncate.
* ``training_examples``: train-mode pruning, prompt and target as padded ids.
* ``zero_shot_inputs``: prune, serialise, prompt with the instruction line,
  tokenise and left-truncate.
* ``evaluation``: clean generated candidates, choose one per task, judge it
  (structural exact match, execution results) and report.
* ``pretraining_blocks``: corpora -> tokens -> weighted mix -> packed blocks.
* ``pruner_evaluation``: coverage@k and AUC of schema-item scores.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import clean_candidate, exact_match
from ..functions.skeleton import question_skeleton, skeleton_tree
from ..functions.text import schema_terms
from ..operators.candidates import first_valid_candidate
from ..operators.metrics import auc, coverage_at_k, evaluation_report
from ..operators.packing import mix_corpora, pack_blocks, tokenize
from ..operators.prompts import few_shot_prompts, schema_sequence, sft_example, truncate_left, zero_shot_prompt
from ..operators.retrieval import Cosine, SparseCosine, TreeDistance, tfidf_vectors, topk_similar
from ..operators.schema_items import filter_foreign_keys, filter_matched_map, label_topup_sample, prune_eval
from ..sources.tasks import foreign_keys, rebuild_schema, schema_columns, schema_tables


def _rebuilt(tasks: DataFrame, kept_tables: DataFrame, kept_columns: DataFrame) -> DataFrame:
    """(task_id, schema, matched_contents) of the kept items: ``kept_tables`` (task_id,
    table_pos, table_rank), ``kept_columns`` (task_id, table_pos, col_pos, col_rank).
    Foreign keys stay between surviving tables (J5), matched contents with their
    column (J6)."""
    tables = schema_tables(tasks).join(kept_tables.select("task_id", "table_pos", "table_rank"), ["task_id", "table_pos"])
    cols = schema_columns(tasks).join(kept_columns.select("task_id", "table_pos", "col_pos", "col_rank"),
                                      ["task_id", "table_pos", "col_pos"])
    fks = filter_foreign_keys(foreign_keys(tasks), tables)
    rebuilt = rebuild_schema(tables, cols, fks)
    # tasks whose tables were all pruned still get an (empty) schema
    empty = F.struct(F.array().cast(rebuilt.schema["schema"].dataType["schema_items"].dataType).alias("schema_items"),
                     F.array().cast("array<array<string>>").alias("foreign_keys"))
    names = F.flatten(F.transform("schema.schema_items", lambda t: F.transform(
        t["column_names"], lambda c: F.concat_ws(".", t["table_name"], c))))
    return (tasks.select("task_id", "matched_contents").join(rebuilt, "task_id", "left")
            .select("task_id", F.coalesce("schema", empty).alias("schema"), "matched_contents").withColumn("_kept", names)
            .select("task_id", "schema", filter_matched_map("matched_contents", "_kept").alias("matched_contents")))


def pruned_schemas(tasks: DataFrame, table_scores: DataFrame, column_scores: DataFrame,
                   k_tables: int, k_columns: int) -> DataFrame:
    """(task_id, schema, matched_contents) after eval-mode pruning, tables in score
    order."""
    kt, kc = prune_eval(table_scores, column_scores, k_tables, k_columns)
    return _rebuilt(tasks, kt, kc)


def training_schemas(tasks: DataFrame, k_tables: int, k_columns: int, seed: int = 42) -> DataFrame:
    """(task_id, schema, matched_contents) after train-mode pruning (L1, L2): all
    labelled tables and columns, topped up to k by seeded negatives, in a seeded
    order."""
    labels = tasks.select("task_id", F.posexplode("table_labels").alias("table_pos", "label"))
    kt = label_topup_sample(labels, ["task_id"], "table_pos", "label", k_tables, seed, "table_rank")
    cols = schema_columns(tasks).select("task_id", "table_pos", "col_pos", "label") \
        .join(kt.select("task_id", "table_pos"), ["task_id", "table_pos"], "left_semi")
    kc = label_topup_sample(cols, ["task_id", "table_pos"], "col_pos", "label", k_columns, seed, "col_rank")
    return _rebuilt(tasks, kt, kc)


def training_examples(tasks: DataFrame, *, k_tables: int = 6, k_columns: int = 10, seed: int = 42, tokenizer=None,
                      max_tokens: int = 8192, bos: int = 1, eos: int = 2, pad: int = 0, cot: bool = True) -> DataFrame:
    """Fine-tuning rows (task_id, example): train-mode pruning, the zero-shot prompt as
    prefix, the task's code as target (P15)."""
    schemas = training_schemas(tasks, k_tables, k_columns, seed)
    x = tasks.select("task_id", "text", "plsql", "skeleton").join(
        schemas.select("task_id", schema_sequence("schema").alias("schema_sequence")), "task_id")
    x = x.withColumn("prompt", zero_shot_prompt("text", "schema_sequence", skeleton="skeleton", cot=cot))
    ids = lambda df, column, out: tokenize(df, column, tokenizer).withColumn(  # noqa: E731  without the end id
        out, F.slice("input_ids", 1, F.size("input_ids") - 1)).drop("input_ids", "length")
    both = ids(ids(x, "prompt", "_p"), "plsql", "_t")
    return both.select("task_id", sft_example("_p", "_t", max_tokens, bos, eos, pad).alias("example"))


def few_shot_inputs(tasks: DataFrame, demos: DataFrame, table_scores: DataFrame, column_scores: DataFrame, *,
                    k_tables: int = 6, k_columns: int = 10, k_demos: int = 3, w: float = 0.5, mode: str = "skeletons",
                    lexicon: DataFrame | None = None, question_vec: str | None = None, cot: bool = True,
                    skeleton: bool = True, tokenizer=None, max_prefix: int = 8192 - 256, bos: Sequence[int] = (1,)) -> DataFrame:
    """Prompts for evaluation tasks with k demonstrations, and their ids (left-truncated
    with BOS if too long) with an attention mask.

    ``mode='skeletons'``: w * norm(question-skeleton cosine) + (1 - w) * norm(code
    skeleton tree similarity).  ``mode='texts'``: the larger of the cosines of the
    texts and of their question skeletons.  Question skeletons need the caller's
    ``lexicon(word, tag)``; ``question_vec`` names a vector column of both tables (an
    encoder's output) to use for them instead of TF-IDF terms.

    Tasks need ``predict_skeleton`` (the predicted code skeleton), demos their own
    ``skeleton`` (the same notation) and ``plsql``."""
    if mode not in ("skeletons", "texts"):
        raise ValueError(f"mode is 'skeletons' or 'texts', not {mode!r}")
    if question_vec is None and lexicon is None:
        raise ValueError("give a lexicon for question skeletons, or a vector column")
    schemas = pruned_schemas(tasks, table_scores, column_scores, k_tables, k_columns)
    sides = []
    for df, name, code in ((tasks, "eval_id", "predict_skeleton"), (demos, "demo_id", "skeleton")):
        side = df.select(F.col("task_id").alias(name), "text", F.col(code).alias("_code"), *([question_vec] if question_vec else []))
        if question_vec is None:
            side = question_skeleton(side, "text", lexicon, out="_question", key=name)
        sides.append(side.withColumn("_tree", skeleton_tree("_code")).withColumn("_key", F.col(name)))
    ev, de = sides
    kinds = [Cosine(question_vec)] if question_vec else [SparseCosine("_qv")]
    if question_vec is None:
        ev, de = (tfidf_vectors(x, "_question", "_qv", key="_key", fit_on=de) for x in (ev, de))
    if mode == "texts":
        ev, de = (tfidf_vectors(x, "text", "_tv", key="_key", fit_on=de) for x in (ev, de))
        top = topk_similar(ev, de, k_demos, kinds=[SparseCosine("_tv"), *kinds], mode="max")
    else:
        top = topk_similar(ev, de, k_demos, kinds=[*kinds, TreeDistance("_tree")], mode="weighted", weights=[w, 1 - w])
    ev_tasks = (tasks.select(F.col("task_id").alias("eval_id"), "text", "predict_skeleton")
                .join(schemas.select(F.col("task_id").alias("eval_id"),
                                     schema_sequence("schema").alias("schema_sequence")), "eval_id"))
    x = few_shot_prompts(ev_tasks, top, demos.select(F.col("task_id").alias("demo_id"), "text", "plsql"),
                         skeleton="predict_skeleton" if skeleton else None, cot=cot)
    tok = tokenize(x, "prompt", tokenizer)
    ids = F.slice("input_ids", 1, F.size("input_ids") - 1)  # no EOS on a prompt
    return tok.withColumn("input_ids", truncate_left(ids, max_prefix, bos=bos)) \
              .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("length")


def zero_shot_inputs(tasks: DataFrame, table_scores: DataFrame, column_scores: DataFrame, *,
                     k_tables: int = 6, k_columns: int = 10, tokenizer=None, max_prefix: int = 8192 - 256,
                     bos: Sequence[int] = (1,), cot: bool = True, skeleton: bool = True) -> DataFrame:
    """Zero-shot prompts (instruction line included) and their left-truncated
    ids with BOS always first."""
    schemas = pruned_schemas(tasks, table_scores, column_scores, k_tables, k_columns)
    x = tasks.select("task_id", "text", "predict_skeleton").join(
        schemas.select("task_id", schema_sequence("schema").alias("schema_sequence")), "task_id")
    x = x.withColumn("prompt", zero_shot_prompt("text", "schema_sequence",
                                                skeleton="predict_skeleton" if skeleton else None, cot=cot))
    tok = tokenize(x, "prompt", tokenizer)
    ids = F.slice("input_ids", 1, F.size("input_ids") - 1)  # no EOS on a prompt
    return tok.withColumn("input_ids", truncate_left(ids, max_prefix, bos=bos, always_bos=True)) \
              .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("length")


def evaluation(tasks: DataFrame, candidates: DataFrame, execution: DataFrame, *, dialect: str = "oracle",
               terms_from: DataFrame | None = None) -> DataFrame:
    """One report row.  ``candidates(task_id, cand_pos, code, error)`` in beam
    order; ``execution(task_id, same)`` says whether the chosen code left
    the database in the gold state (e.g. from ``snapshot_report``); terms
    for cleaning come from ``terms_from(task_id, schema)`` (the pruned
    schemas for few-shot) or the tasks' own schemas (zero-shot)."""
    schemas = terms_from if terms_from is not None else tasks.select("task_id", "schema")
    terms = schemas.select("task_id", schema_terms("schema.schema_items").alias("_terms"))
    cleaned = (candidates.join(terms, "task_id", "left")
               .withColumn("code", clean_candidate("code", F.coalesce("_terms", F.array().cast("array<string>")),
                                                   dialect)).drop("_terms"))
    chosen = first_valid_candidate(cleaned)
    flags = ["insert", "update", "delete", "if", "loop"]
    judged = (tasks.select("task_id", "plsql", *[F.col(f"`{f}`").alias(f) for f in flags])
              .join(chosen, "task_id", "left")
              .join(execution.select("task_id", F.col("same").cast("int").alias("ex")), "task_id", "left")
              .select(F.coalesce("ex", F.lit(0)).alias("ex"), exact_match("plsql", "code", dialect).alias("em"),
                      F.coalesce("no_error", F.lit(0)).alias("no_error"), *flags))
    return evaluation_report(judged, ex="ex", em="em", no_error="no_error")


def pretraining_blocks(parts: Sequence[tuple[str, DataFrame, int]], block_size: int = 8192,
                       tokenizer=None) -> DataFrame:
    """Corpora ``(name, df(row_id, text), weight)`` -> packed blocks."""
    mixed = mix_corpora([(n, tokenize(df, "text", tokenizer), w) for n, df, w in parts])
    return pack_blocks(mixed, block_size)


def pruner_evaluation(items: DataFrame, *, max_k: int = 100) -> dict[str, DataFrame]:
    """``items(task_id, table_pos, col_pos, prob, label)`` with col_pos -1 for
    table rows: coverage@k of tables and of columns, and the two AUCs."""
    t = items.where(F.col("col_pos") < 0)
    c = items.where(F.col("col_pos") >= 0)
    return {
        "table_coverage": coverage_at_k(t, group=["task_id"], score="prob", pos="table_pos", label="label",
                                        max_k=max_k),
        "column_coverage": coverage_at_k(c, group=["task_id", "table_pos"], score="prob", pos="col_pos",
                                         label="label", max_k=max_k, only_with_positives=True),
        "table_auc": auc(t, "label", "prob"),
        "column_auc": auc(c, "label", "prob"),
    }
