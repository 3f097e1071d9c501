import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codeweave.llm.repetition import accepted, base_failed, longest_repeats, repetition

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


def texts():
    rnd = random.Random(5)
    words = ["a", "bé", "c", "naïve", "<x>", "#1", "日本"]
    out = [None, "", " \n\x0b\t", "one", "a b c d e a b c d e", "a " * 2000, "x\n\nx\n x\nx \n", "\n\n\n",
           "a b a b c", "tail\n", "same same\nsame same"]
    for n in (3, 10, 60, 400):
        for _ in range(8):
            out.append("".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(n)))
    passage = " ".join(f"w{i}" for i in range(230))
    filler = " ".join(f"f{i}" for i in range(3000))
    return out + [f"{passage} {filler} {passage}", filler, "word" * 20000]


def test_measures_equal_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x y"), (4, texts()[4])]
    r = F.col("r")
    got = (docs(rows).repartition(1).withColumn("r", repetition(F.col("text")))
           .select("doc_id", "r.*", base_failed(r).alias("bad"), accepted(r).alias("kept")).collect())
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for i, t in enumerate(texts()):
        g, b = by[i], brute(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b, t
        assert g.bad == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert sum(s.end - s.start for s in g.repeats) == g.n_repeat_words
    n = len(texts())
    assert not by[n - 3].bad and not by[n - 3].kept and by[n - 3].longest_repeat == 230
    assert by[n - 2].kept


def test_longest_repeats_of_random_symbols():
    rnd = random.Random(1)
    for _ in range(60):
        parts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(3)]
        flat = np.array([10 * k + s for k, p in enumerate(parts) for s in p], np.uint64)
        ends = np.array([sum(map(len, parts[:k + 1])) for k, p in enumerate(parts) for _ in p])
        got = longest_repeats(flat, ends)
        at = 0
        for p in parts:
            for i in range(len(p)):
                best = 0
                for j in range(len(p)):
                    k = 0
                    while j != i and max(i, j) + k < len(p) and p[i + k] == p[j + k]:
                        k += 1
                    best = max(best, k)
                assert got[at + i] == best
            at += len(p)


def test_empty_table(spark, docs):
    assert docs([]).select(repetition(F.col("text")).alias("r")).collect() == []
