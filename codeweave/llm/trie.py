"""Prefix trie of conversations, with subtree sums by centroid decomposition.

Every prefix of a conversation is a path of marked turns; equal prefixes are one
node, named by its depth and the smallest conversation through it.  A prefix is
recognised by the exclusive-or of 120 hash bits of each of its (position, role,
text) triples, so no prefix is ever spelled out.

A node's size (nodes below and at it) follows from the paths: each conversation
owns the nodes that no smaller one shares, and counts its own ones below.  Subtree
sums come from the parent edges.  A component of the forest is split at its
centroid, the deepest node with at least half of the component below or at it; the
total of the centroid's side is added to every node from the centroid up to the
component's top, and the parts go on alone.  No part has more than half of the
nodes, so a chain of any length is done after a logarithmic number of rounds.
Components of more than ``LIMIT`` nodes are split by joins over all tasks, smaller
ones each inside a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import grouped_exclusive_prefix
from .frames import bounded_batches, kept_table

LIMIT = 1 << 14      # nodes of a component that one task may hold
CHUNK = 256          # turns of one conversation that are hashed along together
FRAGMENT = 1 << 13   # conversation ids joined to one piece of text
WORD = r"[^\x20\x09-\x0D]+"


def marked_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, mark, words): each turn's place 0, 1, ... in its conversation, a hash
    of its role and text, and the words of its text.

    Turns follow the turn number (null first), equal numbers role and text; a null
    role or text is empty.  Rows without a conversation id are left out."""
    known = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one")).where("conv IS NOT NULL")
    placed = grouped_exclusive_prefix(known, ["turn", "role", "text"], "one", ["conv"], "pos")
    said = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return placed.select("conv", F.col("pos").cast("long").alias("pos"), F.sha2(said, 256).alias("mark"),
                         F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words"))


def prefix_paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(path, depth, owner, words): for every conversation of ``convs`` (conv) and each of
    its prefixes, the empty one included, the smallest conversation that starts with it
    and the words of its last turn.  ``turns``: (conv, pos, mark, words)."""
    lane = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    hashed = turns.withColumn("h", F.sha2(F.concat("mark", F.lit(":"), F.col("pos").cast("string")), 256)) \
        .select("conv", "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), lane(1).alias("a"), lane(16).alias("b"), "words")
    hashed = kept_table(hashed, "turns")
    chunks = hashed.groupBy("conv", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = chunks.select("conv", "chunk", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")).alias(f"{c}0") for c in "ab"))
    along = W.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hashed.select("conv", "chunk", "pos", "words", *(F.bit_xor(c).over(along).alias(c) for c in "ab")).join(starts, ["conv", "chunk"])
    prefixes = kept_table(run.select(F.col("conv").alias("path"), (F.col("pos") + 1).alias("depth"), F.col("a").bitwiseXOR(F.col("a0")).alias("a"),
                                     F.col("b").bitwiseXOR(F.col("b0")).alias("b"), "words"), "prefixes")
    owners = prefixes.groupBy("depth", "a", "b").agg(F.min("path").alias("owner"))
    first = convs.agg(F.min("conv")).first()[0]
    roots = convs.select(F.col("conv").alias("path"), F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("owner"),
                         F.lit(0).cast("long").alias("words"))
    return kept_table(prefixes.join(owners, ["depth", "a", "b"]).select("path", "depth", "owner", "words").unionByName(roots), "paths")


def path_ends(paths: DataFrame) -> DataFrame:
    """(path, length, shared): the depth of each path's last node, and of the last one
    that a smaller conversation owns (-1: none)."""
    return paths.groupBy("path").agg(F.max("depth").alias("length"),
                                     F.coalesce(F.max(F.when(F.col("owner") != F.col("path"), F.col("depth"))), F.lit(-1).cast("long")).alias("shared"))


def trie_nodes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv, depth, parent, n_convs, n_children, words, size) for each node; the root's
    parent is null."""
    own = F.col("length") - F.greatest("shared", F.col("depth") - 1)
    nodes = paths.join(ends, "path").groupBy(F.col("owner").alias("conv"), "depth") \
        .agg(F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.sum(own).alias("size"))
    above = paths.select(F.col("path").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    hung = kept_table(nodes.join(above, ["conv", "depth"], "left"), "nodes")
    children = hung.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")) \
                   .agg(F.count(F.lit(1)).alias("n_children"))
    return hung.join(children, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "words", "size")


def balanced_sums(up: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of one tree by centroid decomposition.  Node 0 is the top, parents
    come before their children (``up``: parent's number, any value for the top)."""
    sums = [[0] * len(up) for _ in values]
    size, side = [0] * len(up), [0] * len(up)
    todo = [list(range(len(up)))]
    while todo:
        part = todo.pop()
        top = part[0]
        for i in part:
            size[i] = 1
        for i in reversed(part[1:]):
            size[up[i]] += size[i]
        centre = next(i for i in reversed(part) if 2 * size[i] >= len(part))
        sides: dict[int, list[int]] = {}
        for i in part:   # -1: not below the centroid; else the child of the centroid above it
            side[i] = i if i == centre else -1 if i == top else side[up[i]] if up[i] != centre else i
            sides.setdefault(side[i], []).append(i)
        above = sides.pop(-1, [])
        totals = [sum(v[i] for p in sides.values() for i in p) for v in values]
        sides.pop(centre)
        i = centre
        while True:
            for total, s in zip(totals, sums):
                s[i] += total
            if i == top:
                break
            i = up[i]
        todo += [p for p in (above, *sides.values()) if p]
    return sums


def _small_components(values: list[str]):
    """Kernel over a bucket of whole components: the sums of each node."""
    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy(zero_copy_only=False) for c in ("top", "top_depth", "conv", "depth")}
        order = np.lexsort((col["conv"], col["depth"], col["top_depth"], col["top"]))
        table = group.take(pa.array(order))
        top, top_depth, conv, depth = (col[c][order] for c in ("top", "top_depth", "conv", "depth"))
        parent = table.column("parent").fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(top) != 0) | (np.diff(top_depth) != 0)) + 1
        out: list[list[int]] = [[] for _ in values]
        held = [table.column(v).to_pylist() for v in values]
        for a, b in zip([0, *cuts], [*cuts, len(conv)]):
            at = {key: i for i, key in enumerate(zip(conv[a:b].tolist(), depth[a:b].tolist()))}
            up = [at.get(key, 0) for key in zip(parent[a:b].tolist(), (depth[a:b] - 1).tolist())]
            for o, s in zip(out, balanced_sums(up, [h[a:b] for h in held])):
                o += s
        return pa.Table.from_pydict({"conv": conv, "depth": depth, **{v: pa.array(o, pa.int64()) for v, o in zip(values, out)}})

    return run


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(conv, depth, values): for every node the sums of the long columns ``values`` over
    the nodes below and at it.

    ``nodes``: (conv, depth, parent, size, values); ``paths``: (path, depth, owner), the
    nodes from the root down to each node's conversation's end, as ``prefix_paths``
    gives them."""
    top = ["top", "top_depth"]
    roots = paths.where("depth = 0").select(F.col("path").alias("conv"), F.col("owner").alias("top"))
    current = kept_table(nodes.join(roots, "conv").select("conv", "depth", "parent", "size", *values, "top", F.lit(0).cast("long").alias("top_depth")), "forest")
    ladder, small, added = None, [], []
    while True:
        large = current.where("conv = top AND depth = top_depth AND size > %d" % LIMIT).select(*top, F.col("size").alias("n"))
        if large.isEmpty():
            small.append(current)
            break
        if ladder is None:
            below = paths.select("path", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("below"))
            ladder = kept_table(paths.select("path", "depth", "owner").join(below, ["path", "depth"], "left"), "ladder")
        tagged = current.join(large, top, "left")
        small.append(tagged.where("n IS NULL").drop("n"))
        parts = tagged.where("n IS NOT NULL")
        centre = parts.where("2 * size >= n").groupBy(*top).agg(F.max(F.struct("depth", (-F.col("conv")).alias("c"))).alias("m")) \
                      .select(*top, (-F.col("m.c")).alias("centre"), F.col("m.depth").alias("centre_depth"))
        # a conversation's path tells whether it runs through the centroid, and through which child
        through = ladder.select(F.col("path").alias("conv"), F.col("depth").alias("centre_depth"), F.col("owner").alias("met"), "below")
        met = F.coalesce((F.col("depth") >= F.col("centre_depth")) & (F.col("met") == F.col("centre")), F.lit(False))
        moved = kept_table(parts.join(centre, top).join(through, ["conv", "centre_depth"], "left").withColumn("under", met).drop("met", "n"), "split")
        totals = moved.where("under").groupBy(*top, "centre", "centre_depth").agg(F.count(F.lit(1)).alias("gone"), *(F.sum(v).alias(v) for v in values))
        upward = totals.join(ladder.select(F.col("path").alias("centre"), "depth", F.col("owner").alias("conv")), "centre") \
                       .where("depth BETWEEN top_depth AND centre_depth")
        upward = kept_table(upward.select("conv", "depth", "centre_depth", "gone", *values), "upward")
        added.append(upward.select("conv", "depth", *values))
        left = moved.where("NOT (under AND depth = centre_depth)") \
                    .join(upward.where("depth < centre_depth").select("conv", "depth", "gone"), ["conv", "depth"], "left")
        current = kept_table(left.select("conv", "depth", "parent", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size"), *values,
                                         F.when(F.col("under"), F.col("below")).otherwise(F.col("top")).alias("top"),
                                         F.when(F.col("under"), F.col("centre_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth")), "forest")
    rest = reduce(DataFrame.unionByName, small).select("conv", "depth", "parent", *top, *values)
    buckets = rest.count() // LIMIT + 1
    schema = ", ".join(f"{c} long" for c in ("conv", "depth", *values))
    inside = rest.withColumn("bucket", F.pmod(F.xxhash64(*top), F.lit(buckets))).groupBy("bucket").applyInArrow(_small_components(values), schema)
    every = reduce(DataFrame.unionByName, added, inside)
    return every.groupBy("conv", "depth").agg(*(F.sum(v).alias(v) for v in values))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's sorted members, joined by commas."""
    for batch in batches:
        owner, depth, path = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(path), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])
        first = np.flatnonzero(new)
        run = np.arange(len(path)) - np.repeat(first, np.diff(np.append(first, len(path))))
        cuts = np.flatnonzero(run % FRAGMENT == 0)
        ids = path.tolist()
        said = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(path)))]
        yield pa.RecordBatch.from_pydict({"conv": owner[cuts], "depth": depth[cuts], "path": path[cuts], "said": pa.array(said, pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its fragments, which come in order."""
    def row(node, digest):
        return pa.RecordBatch.from_pydict({"conv": pa.array([n[0] for n in node], pa.int64()), "depth": pa.array([n[1] for n in node], pa.int64()),
                                           "ends_sha256": pa.array(digest, pa.string())})

    node, digest = None, None
    for batch in batches:
        nodes, found = [], []
        for conv, depth, said in zip(batch.column("conv").to_pylist(), batch.column("depth").to_pylist(), batch.column("said").to_pylist()):
            if (conv, depth) == node:
                digest.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    found.append(digest.hexdigest())
                node, digest = (conv, depth), hashlib.sha256()
            digest.update(said.encode())
        if nodes:
            yield row(nodes, found)
    if node is not None:
        yield row([node], [digest.hexdigest()])


def member_digests(members: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): SHA-256 of each node's members' decimal ids, ascending and
    comma-joined.  ``members``: (conv, depth, path).  Ids are joined to fragments where
    they are sorted, over many tasks; a node's fragments then pass one digest in
    order, never held together."""
    bounded_batches(members.sparkSession)
    order = ["conv", "depth", "path"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order) \
                    .mapInArrow(_fragments, "conv long, depth long, path long, said string")
    return pieces.repartition("conv", "depth").sortWithinPartitions(*order).mapInArrow(_digests, "conv long, depth long, ends_sha256 string")


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie: conv_id (its smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes in its
    subtree), saved_tokens (over its subtree, the words of each node's last text for
    every member but one) and ends_sha256 (of the members that end there).

    ``turns``: (conv, pos, mark, words), pos without gaps; ``convs``: (conv), once each,
    those without turns too.  A conversation without turns ends at the root; no
    conversation at all gives no node.  Other columns are not read."""
    turns, convs = turns.select("conv", "pos", "mark", "words"), convs.select("conv")
    paths = prefix_paths(turns, convs)
    ends = kept_table(path_ends(paths), "ends")
    valued = trie_nodes(paths, ends).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")) \
                                    .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = kept_table(valued, "nodes")
    sums = subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"])
    last = paths.join(ends, "path").where("depth = length").select(F.col("owner").alias("conv"), "depth", "path")
    shown = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv", "depth"]).join(member_digests(last), ["conv", "depth"], "left")
    return shown.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
