"""Jaccard join of word n-gram sets by T-occurrence search.

A set of n shingles shares at least T = ceil(0.8 n) of them with any set it is linked
with, so it is enough to look where T of its inverted lists meet.

* Documents with equal sets are one class; the smallest key stands for it.
* Over all tasks: of each set the n - T + l smallest hashes are listed.  Two linked
  sets then have l or more listed shingles in common (l: a sixteenth, of the smaller
  possible partner's set).  A class with fewer listed shingles that anyone else lists
  has no partner.  Of the others the l - 1 shingles with the longest lists are
  skipped: some shingle that both keep is still common to them.  Along each kept
  list, ordered by set size, neighbours of compatible size are chained; chains make
  clusters, and linked sets are in one cluster.
* In a cluster, DivideSkip: of the lists of a set the L longest are set aside, the short
  ones are merged by a heap that leaves out members which cannot come to T - L
  places, and for those that do, the long lists are probed by binary search.  What
  reaches the overlap that both sizes require is linked.  Where the short lists are too
  long for a heap, or the probes too many, entries are counted instead.  A member that is found
  leaves the search, so a large group of copies is found by few searches; links
  span the components.
* A cluster of more than ``BLOCK`` shingles is cut into blocks by set size, and all pairs
  of blocks whose sizes allow a link meet, so nothing is capped.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import grouped_exclusive_prefix
from .components import components
from .frames import bounded_batches, kept_table
from .neardup import shingles
from .words import find, mix, pieces, seeds

EVIDENCE = 16            # one in so many shingles of a set must be found again in the lists
BUCKET_TEXT = 4_000_000  # text bytes for each bucket of lists
BLOCK = 500_000          # shingles of a cluster's block; two blocks meet in a task
HELD = 500_000           # listed shingles that a task holds before it passes them on
FILTER_BITS = 1 << 25
HEAP = 1000              # entries of the short lists that a heap merges; more are counted
ROWS = 255               # lists kept as rows (a byte counts them)
PROBE = 30               # cost of a probe against counting an entry
MU = 0.0085              # cost of a probe against a merge step: how many lists are long

_U = np.uint64


@dataclass(frozen=True)
class Overlap:
    """Two sets are linked if ``over`` * intersection >= ``least`` * union."""

    least: int = 80
    over: int = 100
    shingle: int = 5

    def needed(self, n):
        """T: the least overlap of a set of n with any linked set."""
        return -(-self.least * n // self.over)

    def listed(self, n):
        return n - self.needed(n) + np.maximum(1, n // EVIDENCE)

    def found_again(self, n):
        """Listed shingles that a set of n has in common with any linked set."""
        return np.maximum(1, self.needed(n) // EVIDENCE)

    def linked(self, both, one, other):
        return self.over * both >= self.least * (one + other - both)


def _classes(owner: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Set sizes, and two 64-bit names of each row's whole set."""
    size = np.bincount(owner, minlength=rows)
    full = np.flatnonzero(size)
    names = [np.zeros(rows, _U) for _ in range(2)]
    if len(full):
        start = np.cumsum(size)[full] - size[full]
        for name, salt in zip(names, seeds(2, 41)):
            name[full] = np.add.reduceat(mix(found ^ salt), start)
    return size, names


def _sets(batches, like: Overlap) -> Iterator[tuple]:
    """(batch part, owner, hash, sizes, names) of every piece of the batches."""
    for batch in batches:
        for i, j in pieces(batch.column("text")):
            part = batch.slice(i, j - i)
            owner, found = shingles(find(part.column("text"), lower=True), like.shingle)
            yield part, owner, found, *_classes(owner, found, j - i)


ENTRY = "bucket long, ids binary, hashes binary, numbers binary"


def _pack(bucket: np.ndarray, ids: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """Entries as one row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], (ids[order], hashes[order], numbers[order].astype("<u4"))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts].astype(np.int64)), **{
        name: pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for name, c in zip(("ids", "hashes", "numbers"), columns)}})


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, numbers), by hash and id, each once."""
    ids, hashes, numbers = (np.concatenate([np.zeros(0, t), *(np.frombuffer(b, t) for b in rows.column(c).to_pylist())])
                            for c, t in (("ids", _U), ("hashes", _U), ("numbers", "<u4")))
    order = np.lexsort((ids, hashes))
    ids, hashes, numbers = ids[order], hashes[order], numbers[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return ids[new], hashes[new], numbers[new]


LINK = "a long, b long"


def _as_links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.Table.from_pydict({"a": np.asarray(a).view(np.int64), "b": np.asarray(b).view(np.int64)})


def cluster_links(docs: DataFrame, reps: DataFrame, like: Overlap) -> DataFrame:
    """(a, b): links between classes (their first names) that put all linked ones into
    the same cluster."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET_TEXT + 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held = [np.zeros(0, _U)], [np.zeros(0, _U)], 0
        for part, owner, found, n, (name, _) in _sets(batches, like):
            known = part.column("key").is_valid().to_numpy(zero_copy_only=False)
            rank = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            use = known[owner] & (rank < like.listed(n)[owner])
            ids.append(name[owner[use]])
            hashes.append(found[use])
            held += int(use.sum())
            if held > HELD:
                yield of_lists(ids, hashes)
                ids, hashes, held = [np.zeros(0, _U)], [np.zeros(0, _U)], 0
        yield of_lists(ids, hashes)

    def of_lists(ids, hashes):
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        return _pack(mix(hashes) % _U(buckets), ids, hashes, np.zeros(len(ids)))

    def shared(group: pa.Table) -> pa.Table:
        """Entries of the lists of two classes or more, with the list's length, to their class."""
        ids, hashes, _ = _unpack(group)
        _, at, length = np.unique(hashes, return_inverse=True, return_counts=True)
        more = length[at] > 1
        return pa.Table.from_batches([_pack(ids[more] % _U(buckets), ids[more], hashes[more], np.minimum(length[at][more], (1 << 32) - 1))])

    def kept(classes: pa.Table, entries: pa.Table) -> pa.Table:
        """Of each class with enough of them the entries with the shortest lists, to their list."""
        ids, hashes, length = _unpack(entries)
        name = classes.column("name").to_numpy().view(_U)
        order = np.argsort(name)
        name, n = name[order], classes.column("n_shingles").to_numpy()[order]
        order = np.lexsort((hashes, length, ids))
        ids, hashes = ids[order], hashes[order]
        own, first, count = np.unique(ids, return_index=True, return_counts=True)
        n = n[np.searchsorted(name, own)] if len(own) else np.zeros(0, np.int64)
        take = np.maximum(count - like.found_again(n) + 1, 0)
        use = np.arange(len(ids)) - np.repeat(first, count) < np.repeat(take, count)
        return pa.Table.from_batches([_pack(mix(hashes[use]) % _U(buckets), ids[use], hashes[use], np.repeat(n, count)[use])])

    def chained(group: pa.Table) -> pa.Table:
        ids, hashes, n = _unpack(group)
        n = n.astype(np.int64)
        order = np.lexsort((ids, n, hashes))
        ids, hashes, n = ids[order], hashes[order], n[order]
        next_to = (hashes[1:] == hashes[:-1]) & (like.over * n[:-1] >= like.least * n[1:])
        a, b = ids[:-1][next_to], ids[1:][next_to]
        once = np.unique(mix(a) + b, return_index=True)[1]  # the same neighbours in many lists
        return _as_links(a[once], b[once])

    classes = reps.select(F.col("class_a").alias("name"), "n_shingles", F.lit(None).cast("long").alias("bucket"))
    # the same remainder of the unsigned name as in numpy
    unsigned = F.pmod(F.pmod(F.col("name"), F.lit(buckets)) + F.when(F.col("name") < 0, F.lit((1 << 64) % buckets)).otherwise(0), F.lit(buckets))
    lists = docs.mapInArrow(listed, ENTRY).groupBy("bucket").applyInArrow(shared, ENTRY)
    chosen = classes.withColumn("bucket", unsigned).groupBy("bucket").cogroup(lists.groupBy("bucket")).applyInArrow(kept, ENTRY)
    return chosen.groupBy("bucket").applyInArrow(chained, LINK)


class Lists:
    """Inverted lists over some of a meeting's sets (``members``: their numbers, ascending
    by set size)."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, like: Overlap):
        self.like, self.members, self.sizes = like, members, np.array([len(sets[m]) for m in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        self.names, kind, self.count = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
        order = np.argsort(kind, kind="stable")
        self.places = kind[order] * len(members) + owner[order]  # (list, member), ascending
        self.owners = np.ascontiguousarray(owner[order])
        self.entries = memoryview(self.owners)
        self.first = np.cumsum(self.count) - self.count
        # the longest lists that hold an eighth of the members or more, as rows of zeros and ones
        long = np.flatnonzero(8 * self.count >= len(members)) if len(members) > 64 else np.zeros(0, np.int64)
        long = long[np.argsort(-self.count[long], kind="stable")[:ROWS]]
        self.row = np.full(len(self.count), -1)
        self.row[long] = np.arange(len(long))
        self.rows = np.zeros((len(long), len(members)), np.uint8)
        for k, i in enumerate(long):
            self.rows[k, self.owners[self.first[i]:self.first[i] + self.count[i]]] = 1

    def _merged(self, lists: np.ndarray, low: int, high: int, need: int) -> dict[int, int]:
        """Members of low..high-1 that occur in ``need`` or more of the lists."""
        entries = self.entries
        at, end = self.first[lists].tolist(), (self.first[lists] + self.count[lists]).tolist()
        at = [bisect_left(entries, low, a, e) for a, e in zip(at, end)]
        heap = [(entries[a], i) for i, (a, e) in enumerate(zip(at, end)) if a < e]
        heapq.heapify(heap)
        out = {}
        while len(heap) >= need and heap[0][0] < high:
            member, popped = heap[0][0], []
            while heap and heap[0][0] == member:
                popped.append(heapq.heappop(heap)[1])
            if len(popped) >= need:
                out[member] = len(popped)
                for i in popped:
                    at[i] += 1
            else:   # whatever lies before the need-th smallest front can't come to ``need`` places
                while heap and len(popped) < need - 1:
                    popped.append(heapq.heappop(heap)[1])
                if not heap:
                    break
                front = max(heap[0][0], member + 1)
                for i in popped:
                    at[i] = bisect_left(entries, front, at[i], end[i])
            for i in popped:
                if at[i] < end[i]:
                    heapq.heappush(heap, (entries[at[i]], i))
        return out

    def _counted(self, lists: np.ndarray) -> np.ndarray:
        """In how many of the lists each member occurs."""
        row = self.row[lists]
        out = self.rows[row[row >= 0]].sum(axis=0, dtype=np.uint8).astype(np.int64)
        lists = lists[row < 0]
        n = self.count[lists]
        at = np.arange(n.sum()) + np.repeat(self.first[lists] - (np.cumsum(n) - n), n)
        return out + np.bincount(self.owners[at], minlength=len(self.members))

    def search(self, own: np.ndarray) -> np.ndarray:
        """Members linked with the set ``own``."""
        none = np.zeros(0, np.int64)
        need, n = int(self.like.needed(len(own))), len(own)
        at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        lists = at[self.names[at] == own]
        low = int(np.searchsorted(self.like.over * self.sizes, self.like.least * n))
        high = int(np.searchsorted(self.like.least * self.sizes, self.like.over * n, "right"))
        if len(lists) < need or low >= high:
            return none
        lists = lists[np.argsort(-self.count[lists], kind="stable")]
        longest = int(self.count[lists[0]])
        aside = max(0, min(need - 1, int(need / (MU * math.log2(max(longest, 2)) + 1))))
        apart, short = lists[:aside], lists[aside:]
        if self.count[short].sum() <= HEAP:
            found = self._merged(short, low, high, need - aside)
            member, both = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        else:
            tally = self._counted(short)
            member = low + np.flatnonzero(tally[low:high] >= need - aside)
            both = tally[member]
        if not len(member):
            return none
        if PROBE * len(member) * aside > np.where(self.row[apart] < 0, self.count[apart], len(self.members) // 16).sum():  # so many probes that counting the long lists costs less
            both = both + self._counted(apart)[member]
        else:
            probe = apart[:, None] * len(self.members) + member
            place = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
            both = both + (self.places[place] == probe).sum(axis=0)
        return self.members[member[self.like.linked(both, n, self.sizes[member])]]


def spanning_links(sets: list[np.ndarray], like: Overlap) -> list[tuple[int, int]]:
    """(set, root) links that span the components of the sets, given in ascending size.
    Each set is searched for once, among those that no component holds yet."""
    rest = np.ones(len(sets), bool)
    lists, out = None, []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root], todo = False, [root]
        while todo:
            alive = int(rest.sum())
            if not alive:
                return out
            if lists is None or 2 * alive < len(lists.members):
                lists = Lists(sets, np.flatnonzero(rest), like)
            hit = lists.search(sets[todo.pop()])
            hit = hit[rest[hit]]
            rest[hit] = False
            todo += hit.tolist()
            out += [(h, root) for h in hit.tolist()]
    return out


def _filter_bits(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix(keys.view(_U) + salt) & _U(FILTER_BITS - 1)) for salt in seeds(2, 43)]


def key_filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter of the members' keys, of ``FILTER_BITS`` bits whatever their number:
    keeps the sets of most other documents from being shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(_filter_bits(batch.column(0).to_numpy())))
            word, at = np.unique(bits >> _U(6), return_inverse=True)
            held = np.zeros(len(word), _U)
            np.bitwise_or.at(held, at, _U(1) << (bits & _U(63)))
            yield pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "held": held.view(np.int64)})

    words = members.select("key").mapInArrow(run, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(FILTER_BITS // 64, _U)
    out[words.column("word").to_numpy()] = words.column("held").to_numpy().view(_U)
    return out


def _in_filter(known: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which keys may be members'; null is none."""
    valid = keys.is_valid().to_numpy(zero_copy_only=False)
    for bit in _filter_bits(keys.fill_null(0).to_numpy()):
        valid = valid & ((known[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1)
    return valid


def confirmed_links(members: DataFrame, docs: DataFrame, like: Overlap) -> DataFrame:
    """(a, b): links that span the components of the members (key, n_shingles, cluster)
    of each cluster, judged on whole sets."""
    summed = grouped_exclusive_prefix(members.select("key", "n_shingles", "cluster"), ["n_shingles", "key"], "n_shingles", ["cluster"], "before")
    placed = kept_table(summed.select("key", "n_shingles", "cluster", F.floor(F.col("before") / BLOCK).alias("block")), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    one, two = blocks.alias("one"), blocks.alias("two")
    pairs = one.join(two, (F.col("one.cluster") == F.col("two.cluster")) & (F.col("one.block") <= F.col("two.block"))
                     & (like.over * F.col("one.high") >= like.least * F.col("two.low"))) \
        .select("one.cluster", F.col("one.block").alias("x"), F.col("two.block").alias("y"))
    # a block meets itself where it meets another
    wanted = pairs.withColumn("last", F.max("y").over(W.partitionBy("cluster", "x"))).where("x < y OR last = x")
    meets = wanted.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    buckets = 8 * (placed.agg(F.sum("n_shingles")).first()[0] or 0) // BLOCK + 1

    packed = zlib.compress(key_filter(placed).tobytes(), 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(packed), _U)
        wanted = (batch.filter(pa.array(_in_filter(known, batch.column("key")))) for batch in batches)
        for part, owner, found, n, _ in _sets(wanted, like):
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array([found[e - k:e].tobytes() for e, k in zip(ends, n)], pa.binary())],
                                             ["key", "n", "shingles"])

    held = docs.mapInArrow(sets, "key long, n long, shingles binary")
    rows = held.join(placed.select("key", "cluster", "block"), "key").join(meets, ["cluster", "block"])
    dealt = rows.select(F.xxhash64("cluster", "x", "y").alias("meeting"), "key", "n", "shingles") \
                .withColumn("bucket", F.pmod(F.xxhash64("meeting"), F.lit(buckets)))

    def met(group: pa.Table) -> pa.Table:
        meeting, key, n = (group.column(c).to_numpy() for c in ("meeting", "key", "n"))
        order = np.lexsort((key, n, meeting))
        held = group.column("shingles").to_pylist()
        a, b = [], []
        cuts = np.flatnonzero(np.diff(meeting[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            found = spanning_links([np.frombuffer(held[r], _U) for r in own], like)
            a += [key[own[x]] for x, _ in found]
            b += [key[own[y]] for _, y in found]
        return _as_links(np.array(a, np.int64), np.array(b, np.int64))

    return dealt.groupBy("bucket").applyInArrow(met, LINK)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Overlap = Overlap()) -> DataFrame:
    """One row for each input row: key, n_shingles (distinct shingles of ``shingle`` words,
    A-Z lower-cased; a shorter text is one shingle) and component_id (the smallest key
    that it reaches over links, itself included).

    A null text, or one without words, has no shingles and links with nothing.  A row
    without a key links with nothing, its component is null.  Rows repeated with one
    key are the same document.  Other columns are not read."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, n, names in _sets(batches, like):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in names)],
                                             ["key", "n_shingles", "class_a", "class_b"])

    found = kept_table(rows.mapInArrow(named, "key long, n_shingles long, class_a long, class_b long"), "classes")
    best = F.min(F.struct("key", "n_shingles")).alias("rep")
    reps = kept_table(found.where("key IS NOT NULL AND n_shingles > 0").groupBy("class_a", "class_b").agg(best)
                      .select("class_a", "class_b", "rep.*"), "representatives")
    clusters = components(cluster_links(rows, reps, like))
    members = clusters.join(reps.select(F.col("class_a").alias("node"), "key", "n_shingles"), "node") \
                      .select("key", "n_shingles", F.col("component").alias("cluster"))
    linked = components(confirmed_links(members, rows, like))
    joined = reps.join(linked, F.col("key") == F.col("node"), "left") \
                 .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), F.coalesce("component", "key").alias("component"))
    same = (F.col("class_a") == F.col("a")) & (F.col("class_b") == F.col("b")) & F.col("key").isNotNull() & (F.col("n_shingles") > 0)
    return found.join(joined, same, "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id"))
