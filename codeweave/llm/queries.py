"""Queries over the given tables, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, exact, mixing, neardup, repetition, secrets, substrings, tokenfile, warc
from .frames import bounded_batches, kept_table, shared_folder
from .registry import register, table


def _joined(spans) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    """Secrets of every whole document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS ws FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i,
    unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM found, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
longer AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 199), lambda i: md5(array_to_string(ws[i:i + 200], ' ')))) AS g
    FROM w WHERE len(ws) > 200 AND doc_id IN (SELECT doc_id FROM found))
  GROUP BY doc_id, g HAVING count(*) > 1),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words, longer.doc_id IS NOT NULL AS has_long
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN longer USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR has_long) AS kept
FROM measured"""


@register("op9_repetition_rules", OP9_SQL)
def op9_repetition_rules(spark, sf_dir):
    """Suffix-array repetition of every whole document."""
    bounded_batches(spark)
    r = F.col("r")
    return (table(spark, sf_dir, "documents").select("doc_id", repetition.repetition(F.col("text")).alias("r"))
            .select("doc_id", *(r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    repetition.base_failed(r).alias("base_failed"), repetition.accepted(r).alias("kept")))


@register("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    """Every whole document encoded, and its ids decoded again."""
    bounded_batches(spark)
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), tokens, public_tokenizers.PATTERN).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), tokens))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


@register("op8_block_naming", OP8_SQL)
def op8_block_naming(spark, sf_dir):
    """Exact copies of whole documents."""
    return exact.duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, most * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))
    <= (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) * weight AS is_full
  FROM s WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
    weight * ((sum(source_size) OVER () - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::DOUBLE
      / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())) END AS target FROM f),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1) * 16), substr(h, 1, 1), size, h, doc_id) AS rank,
    ('0x' || substr(md5('mix:offset:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT r.*, j, least(floor(rank * each + (begin + j / 32.0::DOUBLE)) - floor((rank - 1) * each + (begin + j / 32.0::DOUBLE)), 3)::BIGINT * size AS taken
  FROM r, (SELECT unnest(range(32)) AS j)),
n AS (
  SELECT source, j, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - max(target)), j) AS nearest FROM o GROUP BY source, j)
SELECT o.doc_id, o.size, o.source_size, o.target, o.taken
FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source AND o.j = n.j AND nearest = 1"""


@register("op7_systematic_mix", OP7_SQL)
def op7_systematic_mix(spark, sf_dir):
    """What a mix with source weights 5, 2, 1 takes of every document."""
    m = F.col("_mix")
    return mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1], max_repeats=3) \
        .select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
                (m["copies"] * m["size"]).alias("taken"))


def _escaped_sql(column: str) -> str:
    """``chat.escaped`` in DuckDB."""
    sql = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in chat.CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


@register("op4_reply_trees", OP4_SQL)
def op4_reply_trees(spark, sf_dir):
    """Every conversation formatted, written and read back."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    output = kept_table(chat.format_paths(chat.branch_paths(chat.threads(rows))), "conversations")
    said = output.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                         F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return said.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT t, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n AS payload_bytes, sha1(p.t) AS payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN g ON p.t = g.t AND p.n >= 1000"""


@register("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    """Every page written to WARC archives and read back by byte ranges."""
    manifest = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")))
    return warc.read_archives(manifest).select(
        F.col("key").alias("page_id"), "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", "refers_to")


@register("op2_token_grammar")
def op2_token_grammar(spark, sf_dir):
    """Every whole document's ids written as Re-Pair blocks and read back."""
    path = shared_folder(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = tokenfile.read_tokens(spark.read.parquet(path), packed=True)
    return read.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


OP5_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i,
    unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h FROM w WHERE len(ws) >= 50),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM bad, (SELECT unnest(range(50)) AS k)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@register("op5_cover_substrings", OP5_SQL)
def op5_cover_substrings(spark, sf_dir):
    """Words of every whole document that repeat 50 words of an earlier one."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
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
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


@register("op6_minhash_forest", OP6_SQL)
def op6_minhash_forest(spark, sf_dir):
    """Near-duplicate components of whole documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), like=neardup.Likeness(85, 100, 5))
