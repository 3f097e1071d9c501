"""Secret scan: named patterns plus sliding-window Shannon entropy.

The named kinds are regular expressions.  On top, every candidate string (a run
of at least ``WINDOW`` characters that occur in keys) is scanned with a window for
each character class: the window's entropy follows from character counts that
change by one in and one out as it moves.  Windows above the class's threshold
are united to spans; an allow-list and the form of words, names and paths suppress
harmless look-alikes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .words import find, pieces

BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("entropy_hex", "entropy_base32", "entropy_alnum", "entropy_mixed", "entropy_url")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

WINDOW = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
# Character class -> (pattern of its runs, bits a window must reach).  The bits are
# the 1 % quantile of random windows of 16 over 16, 32, 36 and 64 symbols, rounded
# down; a longer key has many windows, and one is enough.  16 letters of English prose
# have 2.7 to 3.8, so words are told by their form (_word_like), not by bits alone.
_CLASSES = {
    "entropy_hex": (re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}"), 2.65),
    "entropy_base32": (re.compile(rf"[A-Z2-7]{{{WINDOW},}}|[a-z2-7]{{{WINDOW},}}"), 3.07),
    "entropy_alnum": (re.compile(rf"[A-Z0-9]{{{WINDOW},}}|[a-z0-9]{{{WINDOW},}}"), 3.12),
    "entropy_mixed": (re.compile(rf"[A-Za-z0-9+/]{{{WINDOW},}}"), 3.37),
    "entropy_url": (re.compile(rf"[A-Za-z0-9_-]{{{WINDOW},}}"), 3.37),
}
# Never secrets: UUIDs, alphabets and digit rows, one kind of letter only.
_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
_ROW = re.compile("|".join(row[:10] + "".join(f"(?:{c}" for c in row[10:]) + ")?" * len(row[10:])
                           for row in (ascii_lowercase, ascii_uppercase, digits)))
_ALLOWED = re.compile(r"[a-z/_=-]+|[A-Z/_=-]+|[0-9/_=+-]+|[A-Z]?[a-z]+(?:[/_=-][A-Z]?[a-z]+)*")
# Parts of names and paths: words in any of the usual cases with digits at either end, or
# one number inside where the cases are mixed; a part under 12 characters may hold more.
_TWO = "A[nst]|B[ey]|D[bo]|Ex|Go|I[dfnost]|M[ey]|No|O[fnr]|Py|So|To|U[ip]|We"
_HUMPS = rf"(?:[A-Z]*+[a-z]{{2,}}+|[A-Z]*(?:{_TWO})(?![a-z]))*+[A-Z]*+"
_PART = re.compile(rf"[0-9]*+|[0-9]{{0,4}}+{_HUMPS}[0-9]{{0,4}}+|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z]){_HUMPS}[0-9]{{1,2}}+[a-z]?{_HUMPS}")
_SHORT_PART = re.compile(r"[0-9]*+(?:[A-Z]?[a-z]++|[A-Z]*+)[0-9]*+(?:[a-z]++|[A-Z]*+)")
_BETWEEN = re.compile(r"[^+/_=-]+")
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 26)]  # one more while the window moves


def high_entropy_spans(run: str, bits: float, window: int = 24) -> list[tuple[int, int]]:
    """United spans of the windows of ``run`` whose Shannon entropy is ``bits`` or more."""
    spans: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window's counts
    most = window * (math.log2(window) - bits)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        counts[c] = n + 1
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            total -= _C_LOG_C[n] - _C_LOG_C[n - 1]
            counts[gone] = n - 1
        if i >= window - 1 and total <= most + 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _word_like(part: str) -> bool:
    return bool(_PART.fullmatch(part) or len(part) < 12 and _SHORT_PART.fullmatch(part))


def entropy_spans(word: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in ``word`` of what the entropy rule finds; of a span inside
    another class's, only the longer, and of equal ones the smaller class's."""
    found = []
    for candidate in _CANDIDATE.finditer(word):
        text = candidate[0]
        for harmless in (_UUID, _ROW):  # only they themselves, not what stands beside them
            text = harmless.sub(lambda m: "=" * len(m[0]), text)  # in no class, and a separator
        if _ALLOWED.fullmatch(text):
            continue
        odd = [p.span() for p in _BETWEEN.finditer(text) if not _word_like(p[0])]  # in order
        if not odd:
            continue
        ends = [b for _, b in odd]
        spans = []
        for kind, (runs, bits) in _CLASSES.items():
            for run in runs.finditer(text):
                for a, b in high_entropy_spans(run[0], bits, WINDOW):
                    next_odd = bisect_right(ends, run.start() + a)  # the first that ends inside or behind
                    if next_odd < len(odd) and odd[next_odd][0] < run.start() + b \
                            and not _ALLOWED.fullmatch(run[0][a:b]):
                        spans.append((kind, run.start() + a, run.start() + b))
        reach = -1
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):  # stable: smaller classes first
            if b > reach:
                found.append((kind, candidate.start() + a, candidate.start() + b))
                reach = b
    return found


def _text_spans(text: str, words: list[tuple[int, str]]) -> list[tuple[str, int, int]]:
    """``words``: (offset, word) of the words that are long enough to hold a key."""
    spans = []
    if any(w in (low := text.encode().lower()) for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for at, word in words:
        if len(word) >= 32:
            spans += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(word) if len(m[0]) >= 32]
        spans += [(kind, at + a, at + b) for kind, a, b in entropy_spans(word)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _kernel(batch: pa.RecordBatch):
    for i, j in pieces(batch.column(1)):
        column = batch.column(1).slice(i, j - i)
        found = find(column)
        long = np.flatnonzero(found.end - found.start >= WINDOW)
        points = np.zeros(len(found.raw) + 1, np.int64)  # code points before each byte
        np.cumsum((found.raw & 0xC0) != 0x80, out=points[1:])
        owners = np.searchsorted(found.at, found.start[long], "right") - 1
        words: dict[int, list] = {}
        for k, owner in zip(long.tolist(), owners.tolist()):
            a, b = found.start[k], found.end[k]
            words.setdefault(owner, []).append((int(points[a] - points[found.at[owner]]), found.raw[a:b].tobytes().decode()))
        spans = [_text_spans(t or "", words.get(k, [])) for k, t in enumerate(column.to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(spans, _SPANS)], ["key", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): for each row the spans (kind, start, end; code points, end
    exclusive) found in its whole text, by start, then kind in the order of
    ``KINDS``.  A null or empty text has no spans; null and repeated keys keep
    their rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    found = map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), _kernel,
                        f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("key", key)
