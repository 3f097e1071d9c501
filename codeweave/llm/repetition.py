"""Quality rules by suffix arrays: how much of a text repeats itself.

The suffix array over a text's words is built by prefix doubling on whole batches
(suffixes of different texts never meet, as a text's words are numbered apart).
The longest common prefix with its neighbours gives for each suffix the deepest
LCP interval that holds it, and so the longest repeat that starts there.  The
united spans of all repeats of ``MIN_REPEAT`` words or more, and the longest one,
are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import column_udf
from .words import _BYTE_POWERS, covered, find, mix, per_text, pieces, seeds

MIN_REPEAT = 5        # words; shorter repeats are ordinary prose
MAX_COVERED = 20      # per cent of the words that may lie in repeats
MAX_LONGEST = 200     # words of the longest passage that may occur twice
MIN_WORDS = 10

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_VALUE = seeds(256, 11)
_LINE_VALUE[10] = 0


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks by prefix doubling: entry k has, for each position, the rank of its first
    2**k symbols, cut at the position's own end.  Positions of equal rank share that
    prefix; a rank is the place of the first of them in the order.  The last entry's
    ranks are all different: the inverse suffix array."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else order
    levels, step = [rank], 1
    open_ = _tied(order, rank)
    while len(open_):
        after = open_ + step
        inside = after < ends[open_]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((second, rank[open_]))
        at, first, second = open_[sort], rank[open_][sort], second[sort]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        place = np.arange(len(at))
        base = np.maximum.accumulate(np.where(group, place, 0))
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        rank = rank.copy()
        rank[at] = first + np.maximum.accumulate(np.where(new, place, 0)) - base
        levels.append(rank)
        open_ = _tied(at, rank)
        step *= 2
    return levels


def _tied(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of positions in rank order those that share their rank."""
    r = rank[at]
    same = r[1:] == r[:-1]
    return at[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(at) else at


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run from it that occurs elsewhere too."""
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    levels = suffix_ranks(symbols, ends)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    pair = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[pair].copy(), right[pair].copy()
    lcp = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        ok = np.flatnonzero((i < ends[left[pair]]) & (j < ends[right[pair]]))
        ok = ok[rank[i[ok]] == rank[j[ok]]]
        lcp[ok] += 1 << k
        i[ok] += 1 << k
        j[ok] += 1 << k
    np.maximum.at(best, left[pair], lcp)
    np.maximum.at(best, right[pair], lcp)
    return best


def _duplicate_lines(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier line."""
    n, texts = len(raw), len(at) - 1
    if not n:
        return np.zeros(texts, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[at[:-1]] = True
    begin[1:] |= raw == 10
    start = np.flatnonzero(begin[:n])
    up, down = _BYTE_POWERS(n)
    name = np.add.reduceat(_LINE_VALUE[raw] * up[:n], start) * down[start]
    worded = np.add.reduceat(in_word.astype(np.int64), start) > 0
    owner = (np.searchsorted(at, start, "right") - 1)[worded]
    kinds, first = np.unique(mix(mix(name[worded]) + mix(owner.astype(np.uint64))), return_index=True)
    return np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)


_RESULT = pa.struct([(name, pa.int64()) for name in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")]
    + [("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "longest_repeat:bigint,repeats:array<struct<start:bigint,end:bigint>>>")


def _measure(column: pa.Array) -> pa.Array:
    found = find(column)
    texts = len(found.at) - 1
    in_word = np.zeros(len(found.raw) + 1, np.int8)
    np.add.at(in_word, found.start, 1)
    np.add.at(in_word, found.end, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    owner = found.owner
    ends = found.first[1:][owner]
    best = longest_repeats(mix(found.hash + mix(owner.astype(np.uint64))), ends)
    long = np.flatnonzero(best >= MIN_REPEAT)
    inside = covered(long, best[long], len(best))
    # united spans: runs of covered words, cut at text bounds
    edge = np.zeros(len(best) + 1, bool)
    edge[found.first] = True
    begin, stop = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    zero = found.first[:-1][owner[begin]] if len(begin) else begin
    bounds = np.searchsorted(begin, found.first)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner, best)
    starts_point = (found.raw & 0xC0) != 0x80
    spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(begin - zero), pa.array(stop - zero)], ["start", "end"]))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(found.first)), pa.array(per_text(in_word & starts_point, found.at)),
         pa.array(per_text(_SYMBOL[found.raw], found.at)), pa.array(_duplicate_lines(found.raw, found.at, in_word)),
         pa.array(per_text(inside, found.first)), pa.array(longest), spans], fields=list(_RESULT))


def _repetition(column: pa.Array) -> pa.Array:
    parts = [_measure(column.slice(i, j - i)) for i, j in pieces(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], _RESULT)


def repetition(text: Column) -> Column:
    """Struct of a text's measures: n_words; word_chars (code points in words);
    n_symbols; n_dup_lines (lines with a word equal to an earlier line);
    n_repeat_words (words in repeats of ``MIN_REPEAT`` words or more, first
    occurrences included); longest_repeat (words); repeats (united word spans).
    A null or empty text, or one without words, has zeros and no spans."""
    return column_udf(_repetition, RESULT)(text)


def base_failed(r: Column) -> Column:
    """Too short, or more than ``MAX_COVERED`` per cent in repeats."""
    return (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_COVERED * r["n_words"])


def accepted(r: Column) -> Column:
    """The rules' verdict on the struct of ``repetition``."""
    return ~base_failed(r) & (r["longest_repeat"] <= MAX_LONGEST)
