"""Demonstration retrieval: pairwise similarity, min-max normalisation,
fusion and per-eval top-k (J1, J2 via similarity kinds, A1-A3, W1).

Plan shape
----------
All (eval, demo) pairs count, as in the reference, but they are never rows:

* rows are named by the digest of their values, and ids travel with digests; of a demo
  value only the k smallest demo ids can be in any top k, of an eval value one row is
  scored: copies are merged within a batch before they travel, the rest in their cell;
* both sides' distinct values are dealt to a grid of cells: a value is copied to the
  cells of its row or column only (``GRID``, more where a part would outgrow a task);
  a cell is a co-group, which scores run against run and keeps the k best for each
  eval value;
* Spark ranks these few survivors with a ``row_number`` window
  (``WindowGroupLimit`` prunes before the shuffle) and joins the evals back.

Nothing is collected or broadcast; only the numbers of blocks and the global
extrema (A1/A2/A3; from the partial extrema of the same blocks) reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_OR_SYMBOL
from ..functions.trees import Tree, tree_edit_distance

SCALE = 1_000_000  # scores are rounded to 6 decimals before ranking
EVAL_ROWS, DEMO_ROWS = 1024, 512  # distinct values scored at once
GRID, CELL_ROWS = 8, 16_384       # parts of a side, and values that a part may hold
DENSE_TERMS, DENSE_PAIRS = 1024, 4096  # terms in a matrix product: most, and pairs from which one is
PAIRS = 1 << 22                   # posting pairs expanded at once


# ---------------------------------------------------------------------------
# Similarity kinds: ``pack`` turns a run of column values into arrays, ``scores``
# gives the (demo x eval) matrix of two packed runs.
# ---------------------------------------------------------------------------

def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds and values of a list column (null: empty)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(column)


@dataclass(frozen=True)
class Cosine:
    """Cosine similarity of two vector columns (array<float|double>)."""
    column: str
    is_distance: bool = False

    def pack(self, column: pa.Array) -> np.ndarray:
        bounds, values = _flat(column)
        mat = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return mat / np.linalg.norm(mat, axis=1, keepdims=True)  # zero vectors give NaN, as cosine is undefined there

    def scores(self, evals: np.ndarray, demos: np.ndarray) -> np.ndarray:
        return demos @ evals.T


@dataclass(frozen=True)
class _Postings:
    """Postings of a run of rows, by term: ``row`` and unit ``weight`` of term i stand at
    ``start[i]:start[i + 1]``; rows without any direction are ``empty``."""
    terms: np.ndarray
    start: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    empty: np.ndarray

    def dense(self, at: np.ndarray) -> np.ndarray:
        """(row x chosen term) matrix."""
        out = np.zeros((len(self.empty), len(at)))
        for k, i in enumerate(at):
            own = slice(self.start[i], self.start[i + 1])
            out[self.row[own], k] = self.weight[own]
        return out


@dataclass(frozen=True)
class SparseCosine:
    """Cosine similarity of two term columns (array<struct<term:long, weight:double>>,
    see ``tfidf_vectors``).  Both runs are kept as postings by term.  Terms that meet in
    many pairs go through one matrix product; of the others only the pairs that do
    share a term are touched."""
    column: str
    is_distance: bool = False

    def pack(self, column: pa.Array) -> _Postings:
        bounds, values = _flat(column)
        term = values.field("term").to_numpy(zero_copy_only=False)
        weight = values.field("weight").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), np.diff(bounds))
        norm = np.sqrt(np.bincount(row, weight * weight, len(column)))
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = weight / norm[row]
        order = np.argsort(term, kind="stable")
        terms, start = np.unique(term[order], return_index=True)
        return _Postings(terms, np.append(start, len(term)), row[order], weight[order], norm == 0)

    def scores(self, evals: _Postings, demos: _Postings) -> np.ndarray:
        _, x, y = np.intersect1d(evals.terms, demos.terms, assume_unique=True, return_indices=True)
        n, m = np.diff(evals.start)[x], np.diff(demos.start)[y]
        often = np.zeros(len(x), bool)
        often[np.argsort(-(n * m), kind="stable")[:DENSE_TERMS]] = True
        often &= n * m >= DENSE_PAIRS
        out = demos.dense(y[often]) @ evals.dense(x[often]).T
        x, y, n, m = x[~often], y[~often], n[~often], m[~often]
        # all (eval posting, demo posting) pairs of a term, for all terms at once
        pairs = np.cumsum(n * m)
        for a, b in _runs(pairs, PAIRS):
            size, width = (n * m)[a:b], m[a:b]
            term = np.repeat(np.arange(b - a), size)
            k = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
            e, d = evals.start[x[a:b]][term] + k // width[term], demos.start[y[a:b]][term] + k % width[term]
            out += np.bincount(demos.row[d] * out.shape[1] + evals.row[e], evals.weight[e] * demos.weight[d], out.size).reshape(out.shape)
        out[demos.empty, :] = np.nan  # an empty text has no direction
        out[:, evals.empty] = np.nan
        return out


def _runs(total: np.ndarray, most: int):
    """Runs [a, b) of entries with running totals ``total`` that add up to about ``most``."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@dataclass(frozen=True)
class Equality:
    """1.0 when the two values are equal, else 0.0 (a categorical match)."""
    column: str
    is_distance: bool = False

    def pack(self, column: pa.Array) -> list:
        return column.to_pylist()

    def scores(self, evals: list, demos: list) -> np.ndarray:
        names: dict = {}  # equal values get one number; numbers are compared, not values
        try:
            e, d = (np.array([names.setdefault(v, len(names)) for v in side], np.int32) for side in (evals, demos))
        except TypeError:  # lists and the like
            return np.array([[x == y for y in evals] for x in demos], np.float64).reshape(len(demos), len(evals))
        return (d[:, None] == e[None, :]).astype(np.float64)


@dataclass(frozen=True)
class TreeDistance:
    """Edit distance of skeleton trees given as preorder arrays of
    struct(depth, value) (see ``functions.skeleton.skeleton_tree``).  It is a
    distance: scores use (max - d) / (max - min).  Its bounds keep most pairs from
    being scored."""
    column: str
    is_distance: bool = True

    def pack(self, column: pa.Array) -> list[Tree]:
        return [Tree(v) for v in column.to_pylist()]

    def scores(self, evals: list[Tree], demos: list[Tree]) -> np.ndarray:
        return np.array([[tree_edit_distance(d, e) for e in evals] for d in demos], dtype=np.float64).reshape(len(demos), len(evals))

    def bounds(self, evals: list[Tree], demos: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance that each (demo, eval) pair can have, from
        the nodes below the roots alone.

        A child of the longer list that isn't set against one with its label and number
        of children costs 1 or more, whatever happens to it.  At most, one side's
        children go along the border, at 1 each, and the other side's nodes all come."""
        names: dict = {}
        for t in (*evals, *demos):
            for c in t.children[0]:
                names.setdefault((t.values[c], len(t.children[c])), len(names))

        def counts(trees):
            out = np.zeros((len(trees), len(names)), np.int32)
            for i, t in enumerate(trees):
                for c in t.children[0]:
                    out[i, names[t.values[c], len(t.children[c])]] += 1
            return out, np.array([len(t.children[0]) for t in trees], np.int64), np.array([t.sizes[0] - 1 for t in trees], np.int64)

        (have_e, kids_e, nodes_e), (have_d, kids_d, nodes_d) = counts(evals), counts(demos)
        common = np.zeros((len(demos), len(evals)), np.int64)
        for k in np.flatnonzero(have_e.any(axis=0) & have_d.any(axis=0)):
            common += np.minimum(have_d[:, k, None], have_e[None, :, k])
        roots = np.array([[d.values[0] != e.values[0] for e in evals] for d in demos], np.int64).reshape(common.shape)
        low = np.maximum(kids_d[:, None], kids_e[None, :]) - common + roots
        high = np.minimum(kids_d[:, None] + nodes_e[None, :], kids_e[None, :] + nodes_d[:, None]) + roots
        return low.astype(np.float64), high.astype(np.float64)

    def score(self, one: Tree, other: Tree) -> float:
        return float(tree_edit_distance(other, one))


# ---------------------------------------------------------------------------
# The distributed kernel
# ---------------------------------------------------------------------------

def _fused(kinds, blocks, mode, weights, extrema):
    """Scores from raw similarities: distances count as (max - d) / (max - min) in
    every mode (constant: 1), similarities are normalised in ``weighted`` only."""
    out = None
    for i, (kind, blk) in enumerate(zip(kinds, blocks)):
        if kind.is_distance or mode == "weighted":
            lo, hi = extrema[i]
            if lo is None or hi is None or not hi > lo:
                blk = np.full_like(blk, 1.0 if kind.is_distance else 0.0)
            else:
                blk = hi - blk if kind.is_distance else blk - lo
                blk /= hi - lo  # an array of its own
        if mode == "weighted":
            blk = weights[i] * blk
            out = blk if out is None else np.add(out, blk, out=out)
        else:
            out = blk if out is None else np.maximum(out, blk)  # NaN wins, as in numpy
    return out


@dataclass
class _Run:
    """A run of values of one side of a cell: their ids, counts and packed columns."""
    ids: np.ndarray
    only: np.ndarray
    n: np.ndarray
    packed: list


def _packed_runs(kinds, rows: pa.Table, name: str, size: int) -> list[_Run]:
    """The cell's values by ascending id, packed run by run."""
    if "_value" in rows.column_names:
        rows = _merged(rows, name)
    rows = rows.sort_by(name).combine_chunks()
    column = lambda part, c: part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c)
    out = []
    for a in range(0, rows.num_rows, size):
        part = rows.slice(a, size).combine_chunks()
        ids, n = (column(part, c).to_numpy() for c in (name, "_n"))
        out.append(_Run(ids, ids, n, [k.pack(column(part, k.column)) for k in kinds]))
    return out


def _meetings(kinds, evals: pa.Table, demos: pa.Table):
    """(eval run, demo run) pairs of a cell, demos in ascending order."""
    held = _packed_runs(kinds, demos, "_d", DEMO_ROWS)
    for e in _packed_runs(kinds, evals, "_v", EVAL_ROWS):
        for d in held:
            yield e, d


def bounded_extrema(kind, evals: list, demos: list, counts: np.ndarray) -> tuple[float | None, float | None, int]:
    """The exact least and largest score among the pairs that count, and how many pairs
    had to be scored: pairs go by their bounds, until no bound is beyond what is found."""
    low, high = kind.bounds(evals, demos)
    scored: dict[int, float] = {}

    def extreme(bound, sign):
        best = None
        for at in np.argsort(sign * bound, axis=None, kind="stable"):
            if not counts.flat[at]:
                continue
            if best is not None and sign * bound.flat[at] >= sign * best:
                break
            if at not in scored:
                d, e = divmod(int(at), len(evals))
                scored[at] = kind.score(evals[e], demos[d])
            best = scored[at] if best is None or sign * scored[at] < sign * best else best
        return best

    return extreme(low, 1), extreme(high, -1), len(scored)


def bounded_scores(kinds, e: _Run, d: _Run, k: int, fuse, held: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(eval x demo) rounded scores in which every demo that can be among an eval's k best
    has its exact one, and the number of pairs scored; the others have minus infinity.

    Distances with bounds enter as their least value first, which makes a score an upper
    bound; an eval's demos are scored from the best bound down until the k-th best
    score (``held``: its best ones so far) is above the next bound."""
    blocks = [kd.bounds(x, y)[0] if hasattr(kd, "bounds") else kd.scores(x, y) for kd, x, y in zip(kinds, e.packed, d.packed)]
    upper = np.rint(fuse(blocks) * SCALE).T
    score, scored = np.where(np.isnan(upper), np.nan, -np.inf), 0
    for row in range(len(upper)):
        best = sorted([v for v in held[row] if not np.isnan(v)] if held is not None else [], reverse=True)[:k]
        order = np.argsort(np.where(np.isnan(upper[row]), np.inf, -upper[row]), kind="stable")
        for at in order:
            if np.isnan(upper[row, at]) or len(best) == k and upper[row, at] < best[-1]:
                break
            one = [np.array([[kd.score(x[row], y[at])]]) if hasattr(kd, "bounds") else blk[at:at + 1, row:row + 1]
                   for kd, x, y, blk in zip(kinds, e.packed, d.packed, blocks)]
            score[row, at] = np.rint(fuse(one)[0, 0] * SCALE)
            scored += 1
            if not np.isnan(score[row, at]):
                best = sorted([*best, score[row, at]], reverse=True)[:k]
    return score, scored


def _alone(e: _Run, d: _Run) -> tuple[np.ndarray, np.ndarray]:
    """(demo, eval) places of two values that hold one row each, of the same id."""
    x, y = np.flatnonzero(e.n == 1), np.flatnonzero(d.n == 1)
    _, i, j = np.intersect1d(e.only[x], d.only[y], return_indices=True)
    return y[j], x[i]


def _extrema_fn(kinds, exclude_self):
    names = [f"{x}{i}" for i in range(len(kinds)) for x in ("lo", "hi")]

    def run(evals: pa.Table, demos: pa.Table) -> pa.Table:
        rows = []
        for e, d in _meetings(kinds, evals, demos):
            # a value of one eval and a value of one demo with the same id hold no real pair
            alone, row = _alone(e, d) if exclude_self else (np.zeros(0, np.int64),) * 2, {}
            for i, (kd, x, y) in enumerate(zip(kinds, e.packed, d.packed)):
                if hasattr(kd, "bounds"):
                    counts = np.ones((len(d.ids), len(e.ids)), bool)
                    counts[alone] = False
                    row[f"lo{i}"], row[f"hi{i}"], _ = bounded_extrema(kd, x, y, counts)
                    continue
                vals = kd.scores(x, y)
                vals[alone] = np.nan
                # without initial values, fmin and fmax give NaN if there is nothing else
                ends = [float(f.reduce(vals, axis=None)) for f in (np.fmin, np.fmax)] if vals.size else [np.nan] * 2
                row[f"lo{i}"], row[f"hi{i}"] = (None, None) if np.isnan(ends[0]) else ends
            rows.append(row)
        return pa.Table.from_pylist(rows, pa.schema([(n, pa.float64()) for n in names]))
    return run


def _better(score: np.ndarray, ids: np.ndarray, fused: np.ndarray, demo_ids: np.ndarray) -> None:
    """Take what beats the k best that each eval holds (``score`` and ``ids``, best first,
    changed in place) from a (demo x eval) block of scores.

    Only scores above an eval's k-th are looked at, not sorted blocks.  An equal score
    loses: what is held has smaller ids.  NaN beats nothing."""
    k = score.shape[1]
    last = np.where(np.isnan(score[:, -1]), -np.inf, score[:, -1])
    at, row = np.nonzero(fused >= (last + 0.4) / SCALE)  # rounds to last + 1 or more from last + 0.5 on
    if not len(at):
        return
    fresh = np.rint(fused[at, row] * SCALE)
    keep = fresh > last[row]
    at, row, fresh = at[keep], row[keep], fresh[keep]
    hit = np.unique(row)
    rows = np.concatenate([np.repeat(hit, k), row])
    scores, names = np.concatenate([score[hit].ravel(), fresh]), np.concatenate([ids[hit].ravel(), demo_ids[at]])
    order = np.lexsort((names, np.where(np.isnan(scores), np.inf, -scores), rows))
    first = np.searchsorted(rows[order], hit)
    best = order[first[:, None] + np.arange(k)]
    score[hit], ids[hit] = scores[best], names[best]


def _topk_fn(kinds, k, mode, weights, extrema):
    bounded = any(hasattr(kd, "bounds") for kd in kinds)

    def run(evals: pa.Table, demos: pa.Table) -> pa.Table:
        found: dict[int, tuple] = {}
        fuse = lambda blocks: _fused(kinds, blocks, mode, weights, extrema)
        for e, d in _meetings(kinds, evals, demos):
            if bounded:
                score, _ = bounded_scores(kinds, e, d, k, fuse, found[id(e)][1] if id(e) in found else None)
            else:
                fused = fuse([kd.scores(x, y) for kd, x, y in zip(kinds, e.packed, d.packed)])
                if id(e) in found and found[id(e)][1].shape[1] == k:
                    _better(*found[id(e)][1:], fused, d.ids)
                    continue
                score = np.rint(fused * SCALE).T
            ids = np.broadcast_to(d.ids, score.shape)
            if id(e) in found:  # what is held has smaller ids: the stable sort prefers it
                score, ids = (np.concatenate(x, axis=1) for x in zip(found[id(e)][1:], (score, ids)))
            best = np.argsort(np.where(np.isnan(score), np.inf, -score), axis=1, kind="stable")[:, :k]
            found[id(e)] = (e, np.take_along_axis(score, best, axis=1), np.take_along_axis(ids, best, axis=1))
        values, ids, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for e, score, best in found.values():
            values.append(np.repeat(e.ids, best.shape[1]))
            ids.append(best.ravel())
            sims.append(score.ravel() / SCALE)
        return pa.Table.from_pydict({"_v": np.concatenate(values), "_d": np.concatenate(ids), "sim": pa.array(np.concatenate(sims), from_pandas=True)})
    return run


def _cells(values: int, run: int) -> int:
    """Into how many parts a side is dealt: few enough that a value is copied to ``GRID``
    cells only, as long as a part fits a task (``CELL_ROWS``)."""
    return max(values // CELL_ROWS + 1, min(GRID, values // run + 1))


def _spans(array: pa.Array, at: np.ndarray) -> list[bytes]:
    """Bytes of each run ``at[i]:at[i + 1]`` of an array: equal for equal values only."""
    ends = list(zip(at[:-1].tolist(), at[1:].tolist()))
    cut = lambda a: [a[x:y].tobytes() for x, y in ends]
    parts, kind = [cut(array.is_valid().to_numpy(zero_copy_only=False))], array.type
    if pa.types.is_list(kind):
        bounds, values = _flat(array)
        parts += [cut(np.diff(bounds)), _spans(values, bounds[at])]
    elif pa.types.is_struct(kind):
        parts += [_spans(field, at) for field in array.flatten()]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        values = pc.fill_null(array, 0).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(kind):
            values = values + 0  # one zero and one NaN, as in groups
            values[np.isnan(values)] = np.nan
        parts.append(cut(values))
    else:
        values = array.to_pylist()
        parts.append([repr(values[x:y]).encode() for x, y in ends])
    return list(map(b"".join, zip(*parts)))


def _digests(columns: Sequence[pa.Array]) -> list[bytes]:
    """16 bytes for each row that the rows of the same values share (SHA-256)."""
    at = np.arange(len(columns[0]) + 1)
    return [hashlib.sha256(b"".join(row)).digest()[:16] for row in zip(*(_spans(c, at) for c in columns))]


def _valued(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (``_value``, ``_id``): the digest of the row's values and its id."""
    from ..llm.frames import bounded_batches
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(_digests([batch.column(c) for c in cols]), pa.binary())
            yield pa.RecordBatch.from_arrays([values, batch.column("_id")], ["_value", "_id"])

    return rows.mapInArrow(run, "_value binary, _id long")


def _parted(rows: DataFrame, cols: Sequence[str], name: str, parts: int) -> DataFrame:
    """Rows (``_part``, ``_rows``): the values of a run of rows that belong to one part of
    their side, by their digests, packed.  A value stands once, with its digest, its
    smallest id (``name``) and ``_n`` rows."""
    from ..llm.frames import PACKED_BYTES, bounded_batches, packed_rows, spare_memory
    bounded_batches(rows.sparkSession)

    def packed(held: list[pa.Table]) -> pa.RecordBatch:
        own = _merged(pa.concat_tables(held), name)
        at = np.array([int.from_bytes(v[:8], "little") % parts for v in own.column("_value").to_pylist()], np.int64)
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        blobs = [packed_rows(own.take(pa.array(places))) for places in np.split(order, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["_part", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            values = [batch.column(c) for c in cols]
            own = pa.table({"_value": pa.array(_digests(values), pa.binary()), name: batch.column("_id"), "_n": np.ones(len(batch), np.int64), **dict(zip(cols, values))})
            held.append(_merged(own, name))
            if sum(t.nbytes for t in held) >= PACKED_BYTES:
                yield packed(held)
                held = []
                spare_memory()
        if held:
            yield packed(held)

    return rows.mapInArrow(run, "_part long, _rows binary")


def _on_cells(kernel, out: pa.Schema):
    """``kernel`` over the unpacked values of both sides of a cell."""
    from ..llm.frames import unpacked_rows

    def run(evals: pa.Table, demos: pa.Table) -> pa.Table:
        if not evals.num_rows or not demos.num_rows:
            return out.empty_table()
        return kernel(*(pa.concat_tables([unpacked_rows(b.as_py()) for b in side.column("_rows")]) for side in (evals, demos)))

    return run


def _merged(rows: pa.Table, name: str) -> pa.Table:
    """One row for each ``_value``, with its smallest id and all its rows counted."""
    at = rows.select(["_value", name, "_n"]).append_column("_at", pa.array(np.arange(len(rows)))).combine_chunks()
    at = at.group_by("_value").aggregate([(name, "min"), ("_n", "sum"), ("_at", "min")])
    out = rows.take(at.column("_at_min"))
    for c, f in ((name, "min"), ("_n", "sum")):
        out = out.set_column(out.schema.get_field_index(c), c, at.column(f"{c}_{f}"))
    return out


def topk_similar(evals: DataFrame, demos: DataFrame, k: int, *,
                 kinds: Sequence, mode: str = "single", weights: Sequence[float] | None = None,
                 eval_id: str = "eval_id", demo_id: str = "demo_id",
                 exclude_self: bool = False) -> DataFrame:
    """Top-k demos per eval row by one similarity (``mode='single'``), the
    weighted sum of min-max normalised similarities (``'weighted'``, A1-A3),
    or their element-wise maximum (``'max'``).  A distance always enters as
    (max - d) / (max - min).  Ties at equal rounded score go to the lower demo
    id, as the stable descending sort of the reference gives the lower index.
    ``exclude_self`` drops pairs with equal ids (leave-one-out retrieval inside
    one table).

    Returns ``(eval_id, rank, demo_id, sim)`` with ``sim`` rounded to 6 places.
    Inputs are read several times: checkpoint those that are expensive to
    derive.  The kinds' columns must be groupable (no maps).
    """
    from ..llm.frames import kept_table
    kinds = list(kinds)
    if mode == "weighted":
        weights = list(weights) if weights is not None else [1.0 / len(kinds)] * len(kinds)
    cols = sorted({kd.column for kd in kinds})
    ev = evals.select(F.col(eval_id).cast("long").alias("_id"), *cols)
    de = demos.select(F.col(demo_id).cast("long").alias("_id"), *cols)
    # ids by the digest of their values; the values themselves travel to their cells only
    ev_ids, de_ids = (kept_table(_valued(rows, cols), "values", lean=True) for rows in (ev, de))
    ev_values, de_values = (ids.groupBy("_value").agg(F.min("_id").alias(name)) for ids, name in ((ev_ids, "_v"), (de_ids, "_d")))
    k_value = k + 1 if exclude_self else k  # one more when the eval itself must go
    blocks = {side: _cells(values.count(), size) for side, values, size in (("e", ev_values, EVAL_ROWS), ("d", de_values, DEMO_ROWS))}
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[side] - 1).cast("long"))).alias(f"_b{side}")
    left = _parted(ev, cols, "_v", blocks["e"]).select(F.col("_part").alias("_be"), "_rows", every("d")).groupBy("_be", "_bd")
    right = _parted(de, cols, "_d", blocks["d"]).select(F.col("_part").alias("_bd"), "_rows", every("e")).groupBy("_be", "_bd")
    meet = left.cogroup(right)

    extrema = None
    if mode == "weighted" or any(kd.is_distance for kd in kinds):
        names = [f"{x}{i}" for i in range(len(kinds)) for x in ("lo", "hi")]
        ends = pa.schema([(n, pa.float64()) for n in names])
        row = meet.applyInArrow(_on_cells(_extrema_fn(kinds, exclude_self), ends), ", ".join(f"{n} double" for n in names)) \
            .agg(*[(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in names]).first()
        extrema = [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(kinds))]
    best = pa.schema([("_v", pa.int64()), ("_d", pa.int64()), ("sim", pa.float64())])
    found = meet.applyInArrow(_on_cells(_topk_fn(kinds, k_value, mode, weights, extrema), best), "_v long, _d long, sim double")
    per_value = rank_within(found, "_v", k_value, tie="_d").drop("rank")
    # a demo value stands for its k smallest ids: more can't be in any top k
    by_value = Window.partitionBy("_d").orderBy("_id")
    members = (de_ids.join(de_values, "_value").select("_d", "_id")
               .withColumn("_r", F.row_number().over(by_value)).where(F.col("_r") <= k_value).drop("_r"))
    listed = per_value.join(members.select("_d", F.col("_id").alias(demo_id)), "_d").select("_v", demo_id, "sim")
    listed = rank_within(listed, "_v", k_value, tie=demo_id).drop("rank")
    mapping = ev_ids.join(ev_values, "_value").select("_v", F.col("_id").alias("eval_id"))
    expanded = mapping.join(listed, "_v").select("eval_id", F.col(demo_id).alias("demo_id"), "sim")
    if exclude_self:
        expanded = expanded.where(F.col("demo_id") != F.col("eval_id"))
    return rank_within(expanded, "eval_id", k)


def rank_within(cands: DataFrame, key: str, k: int, score: str = "sim", tie: str = "demo_id") -> DataFrame:
    """Keep the k best rows per key by (score desc, tie asc)."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select(key, F.col("rank").cast("int").alias("rank"), tie, score))


def minmax_normalize(df: DataFrame, col: str, out: str | None = None, distance: bool = False) -> DataFrame:
    """A1 / A2 on a long pair table: the global extrema come from one
    partial-aggregated pass (two scalars reach the driver) instead of an
    unpartitioned window.  Constant input gives 0 for similarities (A1) and 1
    for distances (A2)."""
    out = out or f"{col}_norm"
    ext = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = ext["lo"], ext["hi"]
    if lo is None or hi is None or not hi > lo:
        return df.withColumn(out, F.lit(1.0 if distance else 0.0))
    if distance:
        return df.withColumn(out, (F.lit(hi) - F.col(col)) / F.lit(hi - lo))
    return df.withColumn(out, (F.col(col) - F.lit(lo)) / F.lit(hi - lo))


def fuse_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], col_a: str, col_b: str,
               mode: str = "weighted", w: float = 0.5, out: str = "sim") -> DataFrame:
    """A3 on long pair tables that already exist (e.g. read back from S6):
    weighted sum of the normalised columns or the element-wise maximum."""
    j = a.join(b, list(keys))
    if mode == "max":
        val = F.when(F.isnan(col_a) | F.isnan(col_b), F.lit(float("nan"))).otherwise(F.greatest(col_a, col_b))
    else:
        val = F.lit(w) * F.col(col_a) + F.lit(1 - w) * F.col(col_b)
    return j.withColumn(out, val)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): words and signs of the lower-cased text."""
    return (df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_OR_SYMBOL), 1)).alias("token"))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))


def tfidf_vectors(df: DataFrame, text: str, out: str, *, key: str, fit_on: DataFrame | None = None,
                  carried: Sequence[str] | None = None, repeated: bool | None = None) -> DataFrame:
    """F2 default encoder: ``out`` = the terms of the text as
    array<struct<term:long, weight:double>> (a word's 64-bit hash; count times
    log((N + 1) / (df + 1)) over the N rows of ``fit_on``, default ``df``) for the
    ``SparseCosine`` kind.  Every word counts, whatever their number.  A model
    encoder is any vector column that the caller adds instead.  ``carried``: the columns
    that the result has besides (default: all); the others stay where they are.
    ``repeated``: whether keys repeat or are null, where the caller knows it."""
    from .packing import keys_repeat, looked_up
    pool = fit_on if fit_on is not None else df
    carried = list(df.columns if carried is None else carried)
    total = pool.count()
    tokens = lambda: F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_OR_SYMBOL), 1)
    each = term_counts(pool, key, text) if keys_repeat(pool, key) else pool.select(F.explode(F.array_distinct(tokens())).alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarity = lambda n: F.log((F.lit(total) + 1.0) / (n + 1.0))
    values = seen.select("token", F.struct(F.xxhash64("token").alias("term"), rarity(F.col("df")).alias("rarity")).alias("value"))
    default = F.struct(F.xxhash64("token").alias("term"), rarity(F.lit(0)).alias("rarity"))
    weighed = lambda found, n: F.array_sort(F.zip_with(found, n, lambda v, k: F.struct(v["term"].alias("term"), (k * v["rarity"]).alias("weight"))))
    if not (keys_repeat(df, key) if repeated is None else repeated):
        found = looked_up(df.withColumn("_row", F.struct(*carried)), "_row", tokens(), values, default, bag=True)
        return found.select("_row.*", weighed(F.col("found"), F.col("n")).alias(out))
    counts = term_counts(df, key, text).join(values, "token", "left").withColumn("value", F.coalesce("value", default))
    terms = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("value.term").alias("term"), (F.col("n") * F.col("value.rarity")).alias("weight")))).alias(out))
    empty = F.array().cast("array<struct<term:bigint,weight:double>>")
    return df.select(key, *(c for c in carried if c != key)).join(terms, key, "left").withColumn(out, F.coalesce(F.col(out), empty)).select(*carried, out)
