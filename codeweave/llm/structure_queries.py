"""Queries of the trie, phrase and set-join operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, phrases, trie
from .frames import kept_table
from .registry import register, table


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns taken from conversation c - c % 20
    (h: crc32 of the decimal c, modulo 4): its turns, and all conversations."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    lent = convs.select(F.col("conv").alias("base"), F.col("n").alias("has"))
    plan = convs.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), (F.crc32(F.col("conv").cast("string")) % 4).alias("h")) \
                .join(lent, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    plan = kept_table(plan, "rebuilt")
    own = turns.join(plan, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "words")
    opening = turns.where("pos < 3").withColumnRenamed("conv", "base").join(plan, "base").where("pos < taken") \
                   .select("conv", "pos", "mark", "words")
    return own.unionByName(opening), plan.select("conv")


OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT c, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM ids),
h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, ops), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x)
    WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295) % 4 AS h FROM bits),
o AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (
  SELECT h.c, list_concat(coalesce(base.ts[1:h.h], []), own.ts[h.h + 1:]) AS ts
  FROM h JOIN o own ON own.c = h.c LEFT JOIN o base ON base.c = h.c - h.c % 20),
p AS (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM b),
m AS (SELECT c, d, len(ts) AS n, ts[1:d] AS k, ts[d] AS last FROM p),
own AS (SELECT c, d, n, last, min(c) OVER (PARTITION BY d, k) AS v FROM m),
nodes AS (
  SELECT v, d, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(last).t, ''), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM own GROUP BY v, d),
up AS (SELECT nodes.*, own.v AS parent FROM nodes LEFT JOIN own ON own.c = nodes.v AND own.d = nodes.d - 1),
kids AS (SELECT parent AS v, d - 1 AS d, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (v, d)),
sums AS (
  SELECT own.v, own.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
  FROM full_nodes x JOIN own ON own.c = x.v AND own.d <= x.d GROUP BY own.v, own.d)
SELECT v AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (v, d)"""


@register("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    turns = kept_table(trie.marked_turns(table(spark, sf_dir, "conversations")), "turns")
    return trie.conversation_trie(*rebuilt_turns(turns))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
spans AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
parts AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (
  SELECT *, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM parts)),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, l.f AS l, r.f AS r, n.n AS n, (1000 * c.f * n.n) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = s.lang AND q.m > s.m AND 100 * q.f >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM alone QUALIFY rank <= 2000"""


@register("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark, sf_dir):
    """The collocations of each language's documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, best=2000)


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [md5(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


@register("op13_jaccard_join", OP13_SQL)
def op13_jaccard_join(spark, sf_dir):
    """Components of whole documents over their common word 5-grams."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), like=jaccard.Overlap(80, 100, 5))
