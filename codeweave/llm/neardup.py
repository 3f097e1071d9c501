"""Near-duplicate components by MinHash prefix regions, confirmed on whole shingle sets.

* Documents with equal shingle sets form a class; the smallest key stands for it.
* A representative has ``TREES`` labels of ``DEPTH`` minimum hashes.  In each tree, those
  whose hashed prefixes are equal form a region; no order is sorted and no common prefix
  is measured (banded hashing with one finer step, not a forest's search).  The prefix
  has the shallow depth, in a crowded region the deep one: at that depth a pair at the
  threshold still shares a region of some tree with probability 1 - ``MISS``.
* Within a region, neighbours whose signatures agree enough (five standard
  deviations below the threshold) become candidates.  Only a spanning forest of them
  is kept.  A region that is crowded even at the deep depth is one candidate as a
  whole: nothing is capped.
* Candidate links form clusters.  A cluster's whole shingle sets meet in a task that
  finds all links by shared shingles and keeps a spanning forest.  A large cluster is
  cut into blocks by set size, and all pairs of blocks whose sizes allow a link meet.
* Confirmed links give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import grouped_exclusive_prefix
from .components import components
from .frames import bounded_batches, kept_table, renamed, spare_memory
from .words import Words, find, mix, pieces, seeds, window_starts, windows

TREES, DEPTH = 16, 8
MISS = 2e-5            # probability to overlook a pair just at the threshold
REGION = 1024          # representatives; a region of more is crowded
BLOCK = 1_000_000      # shingles of a cluster that meet in one block
BUCKET_ROWS = 2_000    # signatures dealt to each group of regions

_U = np.uint64
_SCALE = seeds(TREES * DEPTH, 21).astype(np.uint32) | np.uint32(1)
_SHIFT = seeds(TREES * DEPTH, 22).astype(np.uint32)


@dataclass(frozen=True)
class Likeness:
    """Two sets are linked if ``over`` * intersection >= ``least`` * union."""

    least: int = 85
    over: int = 100
    shingle: int = 5

    @property
    def share(self) -> float:
        return self.least / self.over

    @property
    def deep(self) -> int:
        """Longest prefix at which some tree still joins a pair at the threshold."""
        fits = [k for k in range(1, DEPTH + 1) if (1 - self.share ** k) ** TREES <= MISS]
        return max(fits, default=1)

    @property
    def agreement(self) -> int:
        """Signature places (of ``TREES * DEPTH``) that a linked pair shares but for five
        standard deviations."""
        n = TREES * DEPTH
        return max(1, math.floor(n * self.share - 5 * math.sqrt(n * self.share * (1 - self.share))))

    def linked(self, both: np.ndarray, one: int, other: np.ndarray) -> np.ndarray:
        return self.over * both >= self.least * (one + other - both)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of all texts, by owner and hash.  A text
    of fewer words has one: its whole sequence."""
    owner = words.owner
    at = window_starts(words.first, size)
    owners, hashes = [owner[at]], [windows(words.hash, size)[at]]
    count = np.diff(words.first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            owners.append(short)
            hashes.append(mix(windows(words.hash, n)[words.first[short]] + _U(n)))
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


SIGNATURE = "key long, n_shingles long, class_a long, class_b long, signature binary, shallow array<long>, deep array<long>"


def signatures(docs: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """(key, n_shingles, class, signature and the prefixes in each tree) of each row."""
    depths = (max(1, like.deep - 1), like.deep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                words = find(batch.column(1).slice(i, j - i), lower=True)
                owner, found = shingles(words, like.shingle)
                count = np.bincount(owner, minlength=j - i)
                full = np.flatnonzero(count)
                start = np.cumsum(count)[full] - count[full]
                names = [np.zeros(j - i, _U) for _ in range(2)]
                low = np.zeros((j - i, TREES * DEPTH), np.uint32)
                if len(full):
                    for name, salt in zip(names, seeds(2, 23)):
                        name[full] = np.add.reduceat(mix(found ^ salt), start)
                    short = (found >> _U(32)).astype(np.uint32)
                    for k in range(TREES * DEPTH):
                        low[full, k] = np.minimum.reduceat(short * _SCALE[k] + _SHIFT[k], start)
                labels = low.reshape(-1, TREES, DEPTH).astype(_U)
                prefixes = []
                for depth in depths:
                    prefix = np.zeros(labels.shape[:2], _U)
                    for d in range(depth):
                        prefix = mix(prefix + labels[:, :, d] + _U(d + 1))
                    prefixes.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * TREES, TREES), pa.int32()), _signed(prefix.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), *map(_signed, names),
                     pa.array([row.tobytes() for row in (low & np.uint32(255)).astype(np.uint8)], pa.binary()), *prefixes],
                    ["key", "n_shingles", "class_a", "class_b", "signature", "shallow", "deep"])
            spare_memory()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, SIGNATURE)


def _groups(column: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each run of equal values."""
    order = np.argsort(column, kind="stable")
    cuts = np.flatnonzero(np.diff(column[order])) + 1
    yield from np.split(order, cuts) if len(order) else ()


def spanning(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph over 0..n-1 as (node, root); ``near(i, rest)`` says
    which of the nodes ``rest`` are linked with i.  Every node is asked at most once,
    and only about nodes that no tree holds yet."""
    rest, out = np.arange(n), []
    while len(rest):
        root, rest, todo = int(rest[0]), rest[1:], []
        todo.append(root)
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            if hit.any():
                todo += rest[hit].tolist()
                out += [(int(i), root) for i in rest[hit]]
                rest = rest[~hit]
    return out


LINK = "a long, b long"


def _links(keys: np.ndarray, forest: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    return keys[pairs[:, 0]], keys[pairs[:, 1]]


def _table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    return pa.Table.from_pydict({"a": a, "b": b})


def candidate_links(reps: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): spanning links of the representatives that may be linked."""
    spread = reps.select("key", F.posexplode(F.arrays_zip("shallow", "deep")).alias("tree", "t")).select("key", "tree", "t.*")
    sizes = lambda df, by: df.groupBy("tree", by).agg(F.count(F.lit(1)).alias("n"))
    placed = spread.join(sizes(spread, "shallow").where("n > 1"), ["tree", "shallow"])
    calm = placed.where(F.col("n") <= REGION).select("key", "tree", F.col("shallow").alias("region"))
    dense = placed.where(F.col("n") > REGION).select("key", "tree", "deep")
    measured = dense.join(sizes(dense, "deep").where("n > 1"), ["tree", "deep"])
    dense_regions = measured.where(F.col("n") <= REGION).select("key", "tree", F.col("deep").alias("region"))
    whole = measured.where(F.col("n") > REGION)
    chained = whole.join(whole.groupBy("tree", "deep").agg(F.min("key").alias("b")), ["tree", "deep"]) \
                   .where("key <> b").select(F.col("key").alias("a"), "b")
    regions = kept_table(calm.unionByName(dense_regions), "regions")
    buckets = regions.count() // BUCKET_ROWS + 1
    rows = regions.withColumn("bucket", F.pmod(F.xxhash64("tree", "region"), F.lit(buckets))) \
                  .withColumn("region", F.xxhash64("tree", "region")) \
                  .join(reps.select("key", "n_shingles", "signature"), "key")

    def near_in_regions(group: pa.Table) -> pa.Table:
        keys, sizes = (group.column(c).to_numpy() for c in ("key", "n_shingles"))
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
        found = []
        for rows in _groups(group.column("region").to_numpy()):
            own, mark, size = keys[rows], marks[rows], sizes[rows]

            def near(i, rest, mark=mark, size=size):
                fits = like.over * np.minimum(size[rest], size[i]) >= like.least * np.maximum(size[rest], size[i])
                return fits & ((mark[rest] == mark[i]).sum(axis=1) >= like.agreement)

            found.append(_links(own, spanning(len(rows), near)))
        return _table(found)

    return rows.groupBy("bucket").applyInArrow(near_in_regions, LINK).unionAll(chained)


def in_blocks(clusters: DataFrame) -> DataFrame:
    """The members (key, n_shingles, cluster) with ``block``: their cluster, by set size, is
    cut after every ``BLOCK`` shingles.  The running sum is dealt out by ranges."""
    placed = grouped_exclusive_prefix(clusters.select("key", "n_shingles", "cluster"), ["n_shingles", "key"], "n_shingles", ["cluster"], "before")
    return placed.select("key", "n_shingles", "cluster", F.floor(F.col("before") / BLOCK).alias("block"))


def confirmed_links(clusters: DataFrame, docs: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """(a, b): spanning links, true on whole sets, of the members (key, n_shingles,
    cluster) of each cluster."""
    placed = kept_table(in_blocks(clusters), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block"))
                   & (like.over * F.col("a.high") >= like.least * F.col("b.low"))) \
        .select("a.cluster", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    # the pair of a block with itself is part of any pair with another
    wanted = pairs.withColumn("last", F.max("two").over(W.partitionBy("cluster", "one"))).where("one < two OR last = one").drop("last")
    meets = wanted.select("cluster", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    total = placed.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 8 * total // BLOCK + 1
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = texts.join(placed.select("key", "cluster", "block"), "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                owner, found = shingles(find(part.column("text"), lower=True), like.shingle)
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("cluster"), part.column("block"),
                     pa.array([found[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], ["key", "cluster", "block", "shingles"])
            spare_memory()

    member = rows.mapInArrow(sets, "key long, cluster long, block long, shingles binary").join(meets, ["cluster", "block"]) \
        .withColumn("bucket", F.pmod(F.xxhash64("cluster", "one", "two"), F.lit(buckets))) \
        .select("bucket", F.xxhash64("cluster", "one", "two").alias("meeting"), "key", "shingles")

    def link_sets(group: pa.Table) -> pa.Table:
        keys, found = group.column("key").to_numpy(), []
        held = group.column("shingles").to_pylist()
        for rows in _groups(group.column("meeting").to_numpy()):
            own = [np.frombuffer(held[r], _U) for r in rows]
            size = np.array([len(s) for s in own])
            owner = np.repeat(np.arange(len(rows)), size)
            name, kind, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            holders = owner[np.argsort(kind, kind="stable")]
            ends = np.cumsum(count)
            of = np.split(kind, np.cumsum(size)[:-1])

            def near(i, rest, of=of, ends=ends, count=count, holders=holders, size=size):
                mine = of[i][count[of[i]] > 1]
                n = count[mine]
                run = np.arange(n.sum()) + np.repeat(ends[mine] - np.cumsum(n), n)
                both = np.bincount(holders[run], minlength=len(size))[rest]
                return (both > 0) & like.linked(both, size[i], size[rest])

            found.append(_links(keys[rows], spanning(len(rows), near)))
        return _table(found)

    return member.groupBy("bucket").applyInArrow(link_sets, LINK)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """One row for each input row: key, n_shingles (distinct shingles of ``shingle``
    words, A-Z lower-cased), component_id (the smallest key it reaches over links
    between documents whose sets are alike enough, itself included) and kept
    (key = component_id).

    A null text, or one without words, has no shingles and links with nothing.  Rows
    without a key link with nothing: component null, kept.  Rows repeated with one
    key are the same document.  Other columns are not read.
    """
    found = kept_table(signatures(docs, key, text, like), "signatures")
    usable = found.where("key IS NOT NULL AND n_shingles > 0")
    best = F.min(F.struct("key", "n_shingles", "signature", "shallow", "deep")).alias("rep")
    reps = kept_table(usable.groupBy("class_a", "class_b").agg(best).select("class_a", "class_b", "rep.*"), "representatives")
    clusters = components(candidate_links(reps, like)).withColumnRenamed("component", "cluster")
    members = clusters.join(reps.select(F.col("key").alias("node"), "n_shingles"), "node").withColumnRenamed("node", "key")
    # rows of one key and different texts are all part of its document's class
    linked = components(confirmed_links(members, docs, key, text, like))
    joined = reps.select("class_a", "class_b", F.col("key").alias("rep")) \
        .join(linked, F.col("rep") == F.col("node"), "left") \
        .select("class_a", "class_b", F.coalesce("component", "rep").alias("component_id"))
    shown = found.alias("f").join(joined.alias("j"), (F.col("f.class_a") == F.col("j.class_a")) & (F.col("f.class_b") == F.col("j.class_b"))
                                  & F.col("f.key").isNotNull() & (F.col("f.n_shingles") > 0), "left")
    component = F.coalesce(F.col("j.component_id"), F.col("f.key"))
    return shown.select(F.col("f.key").alias(key), "f.n_shingles", component.alias("component_id"), F.col("f.key").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest key of each component."""
    dropped = near_duplicates(docs, key, text, like).where("NOT kept").select(F.col(key).alias("gone")).distinct()
    rows, (own,), back = renamed(docs, key)
    return rows.join(dropped, F.col(own) == F.col("gone"), "left_anti").select(*back)
