"""Chat formatting of reply trees.

Messages form trees by their parent.  Iterative self-joins double the known
distance to the root in each round: first every node's totals to its root, which
rank the branches (one for each leaf) by score, then the nodes on each chosen
branch.  A chosen root-to-leaf path becomes one conversation: one string with
marked turns, and a loss mask of the assistant texts as spans.

Inside texts and roles every control string is broken by a backslash after its
first character and own backslashes are doubled, so the output can be read back
to exactly the same turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import kept_table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Never to stand unescaped in a text: the template's own marks and those of common chat formats.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
CHUNK = 256  # turns put together at once; a long conversation is put together from chunks


def escaped(text: Column) -> Column:
    """The text with control strings broken; null counts as empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        doubled = F.replace(doubled, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return doubled


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``: 0, 1, 2, ... along ``order`` in each group; the first of
    the order is a whole number.  A group is dealt out by runs of that number, so a
    long one doesn't meet in one task."""
    at = F.floor(F.col(order[0]) / CHUNK)
    dealt = rows.withColumn("_run", F.coalesce(at, F.lit(-(1 << 60))))
    runs = dealt.groupBy(F.col(group).alias("_g"), F.col("_run").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(group, "_run").orderBy(*order)
    return dealt.withColumn("_in", F.row_number().over(inside) - 1) \
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r"))) \
        .withColumn("pos", (F.col("_start") + F.col("_in")).cast("long")).drop("_run", "_g", "_r", "_start", "_in")


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, role, text, score).

    Rows follow each other by turn (null first), rows of one turn by role and text;
    each replies to the one before.  Rows without a conversation id form one."""
    known = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = positions(known, "tree", ["turn", "role", "text"])
    return placed.select("tree", F.col("pos").alias("node"), F.when(F.col("pos") > 0, F.col("pos") - 1).alias("parent"),
                         "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    """Join condition on (tree, node) of two aliased sides; a null tree equals itself."""
    (x, p), (y, q) = a.split("."), b.split(".")
    return F.col(f"{x}.tree").eqNullSafe(F.col(f"{y}.tree")) & (F.col(f"{x}.{p}") == F.col(f"{y}.{q}"))


def branch_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, pos, role, text): the nodes of the ``keep`` best branches of each
    tree, pos 0 at the root.

    ``messages``: (tree, node, parent, role, text, score), node unique in its tree.
    A branch's score is the mean of its nodes' scores (null: 0); ties go to the
    smaller leaf.  A node whose parent is null or unknown is a root.  Nodes on a
    cycle, or below one, have no root and belong to no branch; of repeated nodes
    one row counts.
    """
    nodes = messages.dropDuplicates(["tree", "node"]).where("node IS NOT NULL")
    links = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = links.select("tree", F.col("node").alias("up"))
    climb = links.alias("a").join(parents.alias("b"), _same("a.parent", "b.up"), "left") \
        .select("a.tree", "a.node", "b.up", F.lit(1).cast("long").alias("length"), F.col("a.score").alias("total"))
    # after round k: where 2**k steps up from a node lead (null: past the root), how many
    # nodes that passes, and their scores; trees that have got there are set aside
    current, settled, steps = kept_table(climb, "climb"), [], []
    most = current.where("up IS NOT NULL").groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    same_tree = F.col("a.tree").eqNullSafe(F.col("b.tree"))
    while 1 << len(steps) <= most:
        open_trees = current.where("up IS NOT NULL").select("tree").distinct().alias("b")
        settled.append(current.alias("a").join(open_trees, same_tree, "left_anti"))
        moving = kept_table(current.alias("a").join(open_trees, same_tree, "left_semi"), "climb")
        if moving.isEmpty():
            break
        steps.append(moving.where("up IS NOT NULL"))
        further = steps[-1].alias("a").join(moving.alias("b"), _same("a.up", "b.node")).select(
            "a.tree", "a.node", "b.up", (F.col("a.length") + F.col("b.length")).alias("length"), (F.col("a.total") + F.col("b.total")).alias("total"))
        current = kept_table(moving.where("up IS NULL").unionByName(further), "climb")
    else:
        settled.append(current)
    rooted = reduce(DataFrame.unionByName, settled).where("up IS NULL").alias("a")
    leaves = rooted.join(links.alias("b"), _same("a.node", "b.parent"), "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    found = [kept_table(chosen.select("tree", F.col("node").alias("leaf"), "node", "length", F.lit(0).cast("long").alias("dist")), "paths")]
    for k, step in enumerate(steps):
        up = reduce(DataFrame.unionByName, found).alias("a").join(step.alias("b"), _same("a.node", "b.node")) \
            .select("a.tree", "a.leaf", F.col("b.up").alias("node"), "a.length", (F.col("a.dist") + (1 << k)).alias("dist"))
        found.append(kept_table(up, "paths"))
    path = reduce(DataFrame.unionByName, found)
    return path.alias("a").join(nodes.alias("b"), _same("a.node", "b.node")).select(
        "a.tree", "a.leaf", (F.col("a.length") - 1 - F.col("a.dist")).alias("pos"), "b.role", "b.text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss): each path as one string of marked turns, and the
    spans (start, end; code points) of the escaped texts of ``loss_role``.
    Null roles and texts are empty."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turn = paths.select("tree", "leaf", "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), (F.col("role") == loss_role).alias("counts"),
                        head.alias("head"), body.alias("body"))
    sized = turn.withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
    along = W.partitionBy("tree", "leaf", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(along), F.lit(0)) + F.char_length("head")
    placed = sized.withColumn("start", start.cast("long"))
    part = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("said"), F.when(
        F.col("counts"), F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("end"))).alias("span"))
    chunks = placed.groupBy("tree", "leaf", "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("size").alias("size"))
    before = W.partitionBy("tree", "leaf").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    joined = chunks.withColumn("zero", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
        "tree", "leaf", F.struct(
            "chunk", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("said"),
            F.transform(F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()),
                        lambda s: F.struct((s["start"] + F.col("zero")).alias("start"), (s["end"] + F.col("zero")).alias("end"))).alias("spans")).alias("part"))
    whole = joined.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("tree", "leaf", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("formatted"),
                        F.flatten(F.transform("parts", lambda p: p["spans"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.split(formatted, END.replace("|", r"\|"))
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(
        unescaped(F.substr(F.substring_index(t, TEXT, 1), F.lit(len(TURN) + 1))).alias("role"),
        unescaped(F.substr(t, F.char_length(F.substring_index(t, TEXT, 1)) + len(TEXT) + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """array<string>: the texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
