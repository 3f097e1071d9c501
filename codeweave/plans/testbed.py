"""Queries over the driver's tables.  Each one maps the library's operators
onto stand-in tables (SURVEY §7) and reads the whole tables, so its work
grows with them.  The SQL beside each one is the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.retrieval import Cosine, Equality, topk_similar
from .registry import register, spread, table

# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------

_PAIRS_SQL = """
with p as (
  select a.vec_id as eval_id, b.vec_id as demo_id,
         list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s1,
         case when a.label = b.label then 1.0 else 0.0 end as s2
  from embeddings a join embeddings b on a.vec_id <> b.vec_id)
"""


@register("topk_demonstrations", sql=_PAIRS_SQL + """
, r as (select eval_id, demo_id, round(s1, 6) as sim,
               row_number() over (partition by eval_id order by round(s1, 6) desc, demo_id) as rk from p)
select eval_id, cast(rk as integer) as rank, demo_id, sim from r where rk <= 3
""")
def topk_demonstrations(spark, sf):
    emb = table(spark, sf, "embeddings")
    evals = emb.select(F.col("vec_id").alias("eval_id"), "embedding")
    demos = emb.select(F.col("vec_id").alias("demo_id"), "embedding")
    return topk_similar(evals, demos, 3, kinds=[Cosine("embedding")], exclude_self=True)


@register("fused_topk", sql=_PAIRS_SQL + """
, m as (select min(s1) lo1, max(s1) hi1, min(s2) lo2, max(s2) hi2 from p)
, f as (select eval_id, demo_id,
          round(0.5 * case when hi1 > lo1 then (s1 - lo1) / (hi1 - lo1) else 0 end
              + 0.5 * case when hi2 > lo2 then (s2 - lo2) / (hi2 - lo2) else 0 end, 6) as sim
        from p, m)
, r as (select *, row_number() over (partition by eval_id order by sim desc, demo_id) as rk from f)
select eval_id, cast(rk as integer) as rank, demo_id, sim from r where rk <= 3
""")
def fused_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    evals = emb.select(F.col("vec_id").alias("eval_id"), "embedding", "label")
    demos = emb.select(F.col("vec_id").alias("demo_id"), "embedding", "label")
    return topk_similar(evals, demos, 3, kinds=[Cosine("embedding"), Equality("label")],
                        mode="weighted", weights=[0.5, 0.5], exclude_self=True)


@register("fused_topk_max", sql=_PAIRS_SQL + """
, f as (select eval_id, demo_id, round(greatest(s1, s2), 6) as sim from p)
, r as (select *, row_number() over (partition by eval_id order by sim desc, demo_id) as rk from f)
select eval_id, cast(rk as integer) as rank, demo_id, sim from r where rk <= 3
""")
def fused_topk_max(spark, sf):
    emb = table(spark, sf, "embeddings")
    evals = emb.select(F.col("vec_id").alias("eval_id"), "embedding", "label")
    demos = emb.select(F.col("vec_id").alias("demo_id"), "embedding", "label")
    return topk_similar(evals, demos, 3, kinds=[Cosine("embedding"), Equality("label")],
                        mode="max", exclude_self=True)


# Line numbers repeat inside an order in the driver data, so line items used
# as "columns" get a unique 0-based position l_pos per order (same in SQL).
LINES_SQL = ("(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1"
             " as l_pos from lineitem)")


def _lines(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").withColumn("l_pos", (F.row_number().over(w) - 1).cast("int"))


# ---------------------------------------------------------------------------
# Reports (A4, A5, A6, A7, U3)
# ---------------------------------------------------------------------------

def _labelled_docs(spark, sf):
    """labels ⨝ documents as an evaluation log: accurate = quality, exact =
    quality and not toxic, ran = not toxic; the five reported feature flags
    come from lang / toxic; n_chars/1000 stands in for seconds."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf, "labels")
    x = lab.join(d, "doc_id")
    return x.select(
        F.col("quality").alias("ex"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("em"),
        (F.col("toxic") == 0).cast("int").alias("no_error"),
        (F.col("lang") == "en").cast("int").alias("insert"),
        (F.col("lang") == "de").cast("int").alias("update"),
        (F.col("lang") == "fr").cast("int").alias("delete"),
        (F.col("lang") == "es").cast("int").alias("if"),
        F.col("toxic").alias("loop"),
        (F.col("n_chars").cast("double") / 1000.0).alias("secs"))


_EVAL_SQL = """
with x as (
  select l.quality as ex, case when l.quality = 1 and l.toxic = 0 then 1 else 0 end as em,
         case when l.toxic = 0 then 1 else 0 end as no_error,
         case when d.lang = 'en' then 1 else 0 end as f_insert, case when d.lang = 'de' then 1 else 0 end as f_update,
         case when d.lang = 'fr' then 1 else 0 end as f_delete, case when d.lang = 'es' then 1 else 0 end as f_if,
         l.toxic as f_loop, cast(d.n_chars as double) / 1000.0 as secs
  from labels l join documents d using (doc_id))
select cast(count(*) as bigint) as n, cast(sum(ex) as bigint) as accurate, cast(sum(em) as bigint) as exact,
       round(sum(ex) / count(*), 6) as ex, round(sum(em) / count(*), 6) as em,
       cast(sum(no_error) as bigint) as no_error,
       round(sum(f_insert * ex) / greatest(sum(f_insert), 1), 6) as insert_acc, cast(sum(f_insert) as bigint) as insert_total,
       round(sum(f_update * ex) / greatest(sum(f_update), 1), 6) as update_acc, cast(sum(f_update) as bigint) as update_total,
       round(sum(f_delete * ex) / greatest(sum(f_delete), 1), 6) as delete_acc, cast(sum(f_delete) as bigint) as delete_total,
       round(sum(f_if * ex) / greatest(sum(f_if), 1), 6) as if_acc, cast(sum(f_if) as bigint) as if_total,
       round(sum(f_loop * ex) / greatest(sum(f_loop), 1), 6) as loop_acc, cast(sum(f_loop) as bigint) as loop_total,
       round(sum(secs), 6) as total_seconds, round(avg(secs), 6) as mean_seconds
from x
"""


def _round_doubles(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("evaluation_report", sql=_EVAL_SQL)
def evaluation_report_q(spark, sf):
    from ..operators.metrics import evaluation_report
    rep = evaluation_report(_labelled_docs(spark, sf), ex="ex", em="em", no_error="no_error", seconds="secs")
    return _round_doubles(rep)


_AUC_SQL_ONE = """
  (select round((sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)
   from (select y, rank() over (order by sc) + (count(*) over (partition by sc) - 1) / 2.0 as rk
         from (select l.{label} as y, cast(d.n_chars as double) as sc from labels l join documents d using (doc_id))))
"""


@register("auc_report", sql=f"""
select cast({_AUC_SQL_ONE.format(label='quality')} as double) as quality_auc,
       cast({_AUC_SQL_ONE.format(label='toxic')} as double) as toxic_auc,
       cast(round({_AUC_SQL_ONE.format(label='quality')} + {_AUC_SQL_ONE.format(label='toxic')}, 6) as double) as auc_sum
""")
def auc_report_q(spark, sf):
    from ..operators.metrics import auc
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    x = table(spark, sf, "labels").join(d, "doc_id")
    both = (auc(x, "quality", "n_chars").withColumn("m", F.lit("q"))
            .unionByName(auc(x, "toxic", "n_chars").withColumn("m", F.lit("t"))))
    j = both.agg(F.max(F.when(F.col("m") == "q", F.col("auc"))).alias("quality_auc"),
                 F.max(F.when(F.col("m") == "t", F.col("auc"))).alias("toxic_auc"))
    return j.select(F.round("quality_auc", 6).alias("quality_auc"), F.round("toxic_auc", 6).alias("toxic_auc"),
                    F.round(F.col("quality_auc") + F.col("toxic_auc"), 6).alias("auc_sum"))


_COVER_SQL = """
with r as (select l_orderkey, l_returnflag,
                  row_number() over (partition by l_orderkey order by l_extendedprice desc, l_pos) as rk
           from {lines}),
m as (select l_orderkey, max(case when l_returnflag = 'R' then rk else 0 end) as need,
             max(case when l_returnflag = 'R' then 1 else 0 end) as has
      from r group by l_orderkey),
ks as (select unnest(range(1, 101)) as k)
select cast(k as integer) as k, cast(sum(case when need <= k then 1 else 0 end) as bigint) as covered,
       cast(count(*) as bigint) as total
from m, ks {where} group by k
"""


def _coverage(spark, sf, only_pos):
    from ..operators.metrics import coverage_at_k
    li = _lines(spark, sf).select(
        "l_orderkey", "l_pos", "l_extendedprice", (F.col("l_returnflag") == "R").alias("is_used"))
    return coverage_at_k(li, group=["l_orderkey"], score="l_extendedprice", pos="l_pos",
                         label="is_used", max_k=100, only_with_positives=only_pos)


@register("coverage_at_k_tables", sql=_COVER_SQL.format(where="", lines=LINES_SQL))
def coverage_tables_q(spark, sf):
    return _coverage(spark, sf, False)


@register("coverage_at_k_columns", sql=_COVER_SQL.format(where="where has = 1", lines=LINES_SQL))
def coverage_columns_q(spark, sf):
    return _coverage(spark, sf, True)


# ---------------------------------------------------------------------------
# Schema pruning (W2, W3, A11, L1, L2): task = customer, table = order,
# column = line item; scores are prices, labels are status / return flag.
# ---------------------------------------------------------------------------

def _schema_scores(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_pos"),
        F.col("o_totalprice").alias("prob"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    li = _lines(spark, sf).select(
        F.col("l_orderkey").alias("table_pos"), F.col("l_pos").alias("col_pos"),
        F.col("l_extendedprice").alias("prob"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    cols = li.join(o.select("task_id", "table_pos"), "table_pos")
    return o, cols


@register("prune_schema_eval", sql="""
with t as (select o_custkey as task_id, o_orderkey as table_pos,
                  row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as table_rank
           from orders),
kt as (select * from t where table_rank <= 6),
c as (select kt.task_id, kt.table_pos, kt.table_rank, l.l_pos,
             row_number() over (partition by kt.table_pos order by l.l_extendedprice desc, l.l_pos) as col_rank
      from kt join LINES l on l.l_orderkey = kt.table_pos)
select task_id, cast(table_rank as integer) as table_rank, table_pos,
       string_agg(cast(l_pos as varchar), ',' order by col_rank) as column_ids
from c where col_rank <= 10 group by task_id, table_rank, table_pos
""")
def prune_schema_eval_q(spark, sf):
    from ..operators.schema_items import prune_eval, regroup
    o, cols = _schema_scores(spark, sf)
    tables, kept = prune_eval(o, cols, 6, 10)
    per_table = regroup(kept, ["task_id", "table_pos"], "col_rank", ["col_pos"], "cols")
    return (tables.join(per_table, ["task_id", "table_pos"])
            .select("task_id", F.col("table_rank").cast("int").alias("table_rank"), "table_pos",
                    F.array_join(F.transform("cols", lambda x: x["col_pos"].cast("string")), ",")
                    .alias("column_ids")))


@register("prune_schema_train", sql="""
with t as (select o_custkey as task_id, o_orderkey as table_pos,
                  case when o_orderstatus = 'F' then 1 else 0 end as label from orders),
np as (select task_id, sum(label) as npos from t group by task_id),
neg as (select t.*, row_number() over (partition by task_id
          order by md5('42:' || cast(task_id as varchar) || ':' || cast(table_pos as varchar)), table_pos) as r
        from t where label = 0),
kept as (select task_id, table_pos from t where label = 1
         union all select neg.task_id, neg.table_pos from neg join np using (task_id) where r <= 6 - npos),
ko as (select *, row_number() over (partition by task_id
          order by md5('42s:' || cast(task_id as varchar) || ':' || cast(table_pos as varchar)), table_pos) as table_order
       from kept),
c as (select ko.task_id, ko.table_pos, l.l_pos as col_pos,
             case when l.l_returnflag = 'R' then 1 else 0 end as label
      from ko join LINES l on l.l_orderkey = ko.table_pos),
cnp as (select task_id, table_pos, sum(label) as npos from c group by task_id, table_pos),
cneg as (select c.*, row_number() over (partition by task_id, table_pos
           order by md5('42:' || cast(task_id as varchar) || ':' || cast(table_pos as varchar) || ':' || cast(col_pos as varchar)), col_pos) as r
         from c where label = 0),
ckept as (select task_id, table_pos, col_pos from c where label = 1
          union all select cneg.task_id, cneg.table_pos, cneg.col_pos from cneg join cnp using (task_id, table_pos)
          where r <= 10 - npos),
co as (select *, row_number() over (partition by task_id, table_pos
          order by md5('42s:' || cast(task_id as varchar) || ':' || cast(table_pos as varchar) || ':' || cast(col_pos as varchar)), col_pos) as col_order
       from ckept)
select ko.task_id, ko.table_pos, cast(ko.table_order as integer) as table_order,
       coalesce(string_agg(cast(co.col_pos as varchar), ',' order by co.col_order), '') as column_ids
from ko left join co on co.task_id = ko.task_id and co.table_pos = ko.table_pos
group by ko.task_id, ko.table_pos, ko.table_order
""")
def prune_schema_train_q(spark, sf):
    from ..operators.schema_items import label_topup_sample, regroup
    o, cols = _schema_scores(spark, sf)
    kept_t = label_topup_sample(o, ["task_id"], "table_pos", "label", 6, order_col="table_order")
    c = cols.join(kept_t.select("task_id", "table_pos"), ["task_id", "table_pos"], "left_semi")
    kept_c = label_topup_sample(c, ["task_id", "table_pos"], "col_pos", "label", 10, order_col="col_order")
    per_table = regroup(kept_c, ["task_id", "table_pos"], "col_order", ["col_pos"], "cols")
    return (kept_t.join(per_table, ["task_id", "table_pos"], "left")
            .select("task_id", "table_pos", F.col("table_order").cast("int").alias("table_order"),
                    F.coalesce(F.array_join(F.transform("cols", lambda x: x["col_pos"].cast("string")), ","),
                               F.lit("")).alias("column_ids")))


# ---------------------------------------------------------------------------
# Candidate choice (W7, J3): task = conversation, beam position = turn,
# a user turn stands for a candidate that failed to run.
# ---------------------------------------------------------------------------

@register("first_valid_candidate", sql="""
with c as (select conv_id as task_id, turn as cand_pos, text as code,
                  case when role = 'user' then 'failed' end as error from conversations),
ok as (select task_id, min(cand_pos) as p from c where error is null group by task_id),
f as (select task_id, min(cand_pos) as p from c group by task_id),
j as (select f.task_id, ok.p as ok_p, f.p as first_p, oc.code as ok_code, fc.code as first_code
      from f left join ok on ok.task_id = f.task_id
      left join c oc on oc.task_id = f.task_id and oc.cand_pos = ok.p
      join c fc on fc.task_id = f.task_id and fc.cand_pos = f.p)
select task_id,
       case when ok_p is not null then ok_p
            when regexp_replace(first_code, '^\\s+|\\s+$', '', 'g') <> '' then first_p end as chosen_pos,
       md5(case when ok_p is not null then ok_code
                when regexp_replace(first_code, '^\\s+|\\s+$', '', 'g') <> '' then first_code
                else 'PLSQL placeholder' end) as code_md5,
       case when ok_p is not null then 1 else 0 end as no_error
from j
""")
def first_valid_candidate_q(spark, sf):
    from ..operators.candidates import first_valid_candidate
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("cand_pos"), F.col("text").alias("code"),
        F.when(F.col("role") == "user", F.lit("failed")).alias("error"))
    ch = first_valid_candidate(c)
    return ch.select("task_id", "chosen_pos", F.md5("code").alias("code_md5"), "no_error")


# ---------------------------------------------------------------------------
# Snapshots (S8, J10, U2, A10): "before" and "after" snapshots of a few
# tables; the after side applies a status update, appends duplicates and
# reorders rows; one table exists only before, one only after.
# ---------------------------------------------------------------------------

def _snapshots(spark, sf):
    orders = table(spark, sf, "orders")
    after_orders = orders.withColumn(
        "o_orderstatus",
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), F.lit("F"))
        .otherwise(F.col("o_orderstatus")))
    li = table(spark, sf, "lineitem")
    after_li = li.unionByName(li.where((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")))
    cust = table(spark, sf, "customer")
    before = {"orders": orders, "lineitem": li, "customer": cust, "nation": table(spark, sf, "nation")}
    after = {"orders": after_orders, "lineitem": after_li, "customer": cust.orderBy(F.desc("c_custkey")),
             "part": table(spark, sf, "part")}
    return before, after, ["orders", "lineitem", "customer", "nation", "part", "region"]


_ORDERS_AFTER = """(select o_orderkey, o_custkey,
   case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 'F' else o_orderstatus end as o_orderstatus,
   o_totalprice, o_orderdate, o_orderpriority from orders)"""
_LI_AFTER = "(select * from lineitem union all select * from lineitem where l_linenumber = 1 and l_returnflag = 'R')"


def _diff_sql(name, a, b):
    return (f"select '{name}' as table_name, "
            f"case when a_only = 0 and b_only = 0 then 'same' else 'differs' end as status, a_only, b_only from "
            f"(select (select count(*) from (select * from {a} except all select * from {b})) as a_only, "
            f"(select count(*) from (select * from {b} except all select * from {a})) as b_only)")


_SNAP_SQL = " union all ".join([
    _diff_sql("orders", "orders", _ORDERS_AFTER),
    _diff_sql("lineitem", "lineitem", _LI_AFTER),
    _diff_sql("customer", "customer", "customer"),
    "select 'nation', 'missing_b', cast(null as bigint), cast(null as bigint)",
    "select 'part', 'missing_a', cast(null as bigint), cast(null as bigint)",
])


@register("snapshot_diff", sql=_SNAP_SQL)
def snapshot_diff_q(spark, sf):
    from ..operators.snapshots import compare_snapshots
    before, after, tables = _snapshots(spark, sf)
    return compare_snapshots(spark, before, after, tables)


@register("snapshot_report", sql=f"""
select coalesce(bool_and(status = 'same'), true) as overall_same, cast(count(*) as bigint) as tables_compared,
       array_to_string(list_sort(list(table_name) filter (where status <> 'same')), ',') as differing_tables
from ({_SNAP_SQL})
""")
def snapshot_report_q(spark, sf):
    from ..operators.snapshots import compare_snapshots, snapshot_report
    before, after, tables = _snapshots(spark, sf)
    return snapshot_report(compare_snapshots(spark, before, after, tables))


# ---------------------------------------------------------------------------
# Corpus build (S2, P1, P2, U1, A8, W6, L3, L4): documents by language are the
# corpora; English is listed twice (weight 2), as one corpus is in the reference.
# ---------------------------------------------------------------------------

_LANG_WEIGHTS = [("en", 2), ("de", 1), ("fr", 1), ("es", 1), ("other", 1)]


def _corpus_name():
    """The corpus of a document: its language if listed, else (null too) ``other``."""
    listed = F.col("lang").isin(*[lang for lang, _ in _LANG_WEIGHTS])
    return F.when(listed, F.col("lang")).otherwise(F.lit("other"))


def _corpora(spark, sf):
    from ..functions.text import corpus_text
    from ..operators.packing import mix_corpora, tokenize
    docs = table(spark, sf, "documents")
    parts = []
    for lang, w in _LANG_WEIGHTS:
        d = docs.where(_corpus_name() == lang).select(F.col("doc_id").alias("row_id"),
                                                      corpus_text("text").alias("text"))
        parts.append((lang, tokenize(d, "text"), w))  # tokenise once, then repeat by weight
    return mix_corpora(parts)


_CORPUS_SQL = """
with w as (select * from (values ('en', 0, 2), ('de', 1, 1), ('fr', 2, 1), ('es', 3, 1), ('other', 4, 1)) t(corpus, corpus_pos, weight)),
d as (select w.corpus, w.corpus_pos, c.copy, doc_id as row_id,
             cast(len(regexp_extract_all(regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
                                         '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])', 1)) + 1 as bigint) as length
      from documents join w on case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end = w.corpus
      cross join lateral (select unnest(range(1, w.weight + 1)) as copy) c)
"""


@register("mix_and_count", sql=_CORPUS_SQL + """
select corpus, cast(count(*) as bigint) as n_docs, cast(sum(length) as bigint) as n_tokens from d group by corpus
union all
select null, cast(count(*) as bigint), cast(sum(length) as bigint) from d
""")
def mix_and_count_q(spark, sf):
    from ..operators.packing import token_totals
    return token_totals(_corpora(spark, sf))


@register("pack_blocks", sql=_CORPUS_SQL + """
, docs as (select doc_id, list_append(regexp_extract_all(regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
            '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])', 1), chr(2)) as l from documents),
tok as (select doc_id, unnest(l) as token, unnest(range(len(l))) as i from docs),
v as (select token, case when token = chr(2) then 2 else 2 + row_number() over (order by token = chr(2), n desc, token) end as id
      from (select token, count(*) as n from tok group by token)),
o as (select *, coalesce(sum(length) over (order by corpus_pos, copy, row_id
                                           rows between unbounded preceding and 1 preceding), 0) as start from d),
s as (select o.start + tok.i as p, v.id, o.row_id, tok.i from o join tok on tok.doc_id = o.row_id join v on v.token = tok.token),
t as (select cast(sum(length) as bigint) as total from d)
select cast(p // 1024 as bigint) as block_id, arg_min(row_id, p) as first_row, cast(arg_min(i, p) as bigint) as first_offset,
       arg_max(row_id, p) as last_row, cast(arg_max(i, p) as bigint) as last_offset,
       md5(string_agg(cast(id as varchar), ',' order by p)) as ids_md5
from s, t where p // 1024 < total // 1024 group by p // 1024
""")
def pack_blocks_q(spark, sf):
    """W6 on vocabulary ids; the ids of every block are compared."""
    from ..functions.text import corpus_text
    from ..operators.packing import frequency_vocab, mix_corpora, pack_blocks, tokenize_with_vocab
    from ..session import cut_lineage
    docs = table(spark, sf, "documents").select("doc_id", _corpus_name().alias("lang"), corpus_text("text").alias("text"))
    ids = cut_lineage(tokenize_with_vocab(docs, "doc_id", frequency_vocab(docs)).drop("text"))
    parts = [(lang, ids.where(F.col("lang") == lang).withColumnRenamed("doc_id", "row_id"), w) for lang, w in _LANG_WEIGHTS]
    blocks = pack_blocks(mix_corpora(parts), 1024)
    return blocks.select("block_id", "first_row", "first_offset", "last_row", "last_offset",
                         F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"))


@register("vocab_tokenize", sql="""
with t as (select doc_id, unnest(regexp_extract_all(text, '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])', 1)) as token
           from documents),
c as (select token, count(*) as n from t group by token),
v as (select token, row_number() over (order by n desc, token) - 1 + 3 as id from c),
x as (select t.doc_id, count(*) as ntok, sum(case when v.id is null then 1 else 0 end) as unk,
             sum(coalesce(v.id, 0)) as s
      from t left join v on v.token = t.token group by t.doc_id)
select d.doc_id, cast(coalesce(x.ntok, 0) + 1 as integer) as length, cast(coalesce(x.unk, 0) as bigint) as n_unknown,
       cast(coalesce(x.s, 0) + 2 as bigint) as id_sum
from documents d left join x on x.doc_id = d.doc_id
""")
def vocab_tokenize_q(spark, sf):
    """P2 with a frequency vocabulary (all tokens of all documents, ties by
    token), EOS 2."""
    from ..operators.packing import frequency_vocab, tokenize_with_vocab
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tok = tokenize_with_vocab(docs, "doc_id", frequency_vocab(docs))
    return tok.select("doc_id", "length",
                      F.size(F.filter("input_ids", lambda x: x == 0)).cast("long").alias("n_unknown"),
                      F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@register("shards_and_batches", sql="""
with d as (select doc_id, ntile(16) over (order by doc_id) as shard,
                  row_number() over (order by doc_id) - 1 as position, count(*) over () as n from documents)
select doc_id, cast(shard as integer) as shard, cast(position as bigint) as position,
       cast(position // 8 as bigint) as batch
from d where position // 8 < n // 8
""")
def shards_and_batches_q(spark, sf):
    from ..operators.packing import contiguous_shards, fixed_batches
    docs = table(spark, sf, "documents").select("doc_id")
    sh = contiguous_shards(docs, 16, ["doc_id"]).select("doc_id", "shard")
    bt = fixed_batches(docs, 8, ["doc_id"], drop_last=True)
    return bt.join(sh, "doc_id").select("doc_id", "shard", F.col("position").cast("long").alias("position"),
                                        "batch")


# ---------------------------------------------------------------------------
# Code text (P8, P9, P10, A9, S9, S10): procedures synthesised from customer
# rows, in four written variants chosen by the key.  The expression text is
# valid in both Spark SQL and DuckDB.
# ---------------------------------------------------------------------------

_CENTS = "cast(cast(floor(c_acctbal * 100) as bigint) as string)"
ORACLE_CODE_SQL = f"""(case c_custkey % 4
 when 0 then concat('CREATE OR REPLACE PROCEDURE sp(para_bal IN NUMBER) IS BEGIN UPDATE "customer" SET "c_acctbal" = para_bal WHERE "c_custkey" = ', cast(c_custkey as string), '; END;')
 when 1 then concat('create or replace procedure sp( para_bal number ) is begin update "customer" set "c_acctbal"=para_bal where "c_custkey"=', cast(c_custkey as string), ' ; end;')
 when 2 then concat('CREATE OR REPLACE PROCEDURE sp(para_seg VARCHAR2) IS  BEGIN', chr(10), '  DELETE FROM "customer" WHERE "c_mktsegment" = para_seg AND "c_nationkey" = ', cast(c_nationkey as string), ';', chr(10), 'END;')
 else concat('CREATE OR REPLACE PROCEDURE sp(para_x IN NUMBER) IS v_cnt NUMBER; BEGIN SELECT COUNT ( * ) INTO v_cnt FROM "customer" WHERE "c_acctbal" > ', {_CENTS}, ' ; IF v_cnt > 0 THEN UPDATE "customer" SET "c_name" = ''', c_mktsegment, ''' WHERE "c_custkey" = para_x; END IF; END;')
 end)"""
POSTGRES_CODE_SQL = f"""(case c_custkey % 4
 when 0 then concat('CREATE OR REPLACE PROCEDURE sp(para_bal IN numeric) LANGUAGE plpgsql AS $$ BEGIN UPDATE customer SET c_acctbal = para_bal WHERE c_custkey = ', cast(c_custkey as string), '; END; $$;')
 when 1 then concat('create or replace procedure sp( para_bal numeric )  language plpgsql as $$ begin update customer set c_acctbal=para_bal where c_custkey=', cast(c_custkey as string), ' ; end ; $$ ;')
 when 2 then concat('CREATE OR REPLACE PROCEDURE sp(para_seg text) LANGUAGE plpgsql AS $$', chr(10), 'BEGIN DELETE FROM customer WHERE c_mktsegment = para_seg AND c_nationkey = ', cast(c_nationkey as string), '; END; $$;')
 else concat('CREATE OR REPLACE PROCEDURE sp(para_x integer) LANGUAGE plpgsql AS $$ DECLARE v_cnt integer; BEGIN SELECT COUNT(*) INTO v_cnt FROM customer WHERE c_acctbal > ', {_CENTS}, '; IF v_cnt > 0 THEN UPDATE customer SET c_name = ''', c_mktsegment, ''' WHERE c_custkey = para_x; END IF; EXCEPTION WHEN OTHERS THEN RAISE NOTICE ''failed''; END; $$;')
 end)"""
# A "prediction" for every gold procedure: renamed variable and other spacing
# (same shape) unless the key is a multiple of 3, where the statement differs.
ORACLE_PRED_SQL = f"""(case when c_custkey % 7 = 3 then replace({ORACLE_CODE_SQL}, ' AND ', ' LIKE ')
 when c_custkey % 3 = 0 then replace(replace({ORACLE_CODE_SQL}, 'UPDATE "customer" SET', 'INSERT INTO "customer" VALUES'), 'update "customer" set', 'insert into "customer" values')
 else replace(replace({ORACLE_CODE_SQL}, 'para_', 'p_'), ' = ', '  =  ') end)"""
POSTGRES_PRED_SQL = f"""(case when c_custkey % 3 = 0 then replace({POSTGRES_CODE_SQL}, ' = ', ' > ')
 else replace(replace({POSTGRES_CODE_SQL}, 'para_', 'arg_'), 'BEGIN', chr(10) || 'BEGIN ') end)"""


def _duck_regex_chain(expr: str, dialect: str) -> str:
    from ..functions import code as C

    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    def repl(r):
        return r.replace("\\$", "$").replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")

    def collapse(e):
        return f"regexp_replace(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    e = collapse(expr)
    rules = C.oracle_rules() if dialect == "oracle" else C.postgres_rules()
    for pat, rp, icase in rules:
        e = f"regexp_replace({e}, {lit(pat)}, {lit(repl(rp))}, '{'gi' if icase else 'g'}')"
    e = collapse(e)
    if dialect != "oracle":
        e = f"regexp_replace({e}, {lit(C._BODY_OPEN + '(.*?)' + C._BODY_CLOSE)}, '$$\\1$$', 'g')"
    return e


# The words of the test procedures that are not names, spelled out here so that a
# wrong keyword rule shows.
_CODE_WORDS = ("CREATE OR REPLACE PROCEDURE IS BEGIN END UPDATE SET WHERE DELETE FROM AND SELECT COUNT INTO IF THEN INSERT "
               "VALUES NUMBER VARCHAR2 LIKE").split()
_POSTGRES_WORDS = ("CREATE OR REPLACE PROCEDURE LANGUAGE AS BEGIN END UPDATE SET WHERE DELETE FROM AND SELECT INTO IF THEN DECLARE "
                   "EXCEPTION WHEN RAISE NOTICE NUMERIC INTEGER TEXT").split()


def _duck_fingerprint(norm_expr: str, dialect: str) -> str:
    kw = "[" + ", ".join(f"'{k}'" for k in (_CODE_WORDS if dialect == "oracle" else _POSTGRES_WORDS)) + "]"
    pat = (r"'(''[^'']*(?:''''[^'']*)*''|\.\.|(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?|[\p{L}_][\p{L}\p{N}_$#]*(?:\.[\p{L}_][\p{L}\p{N}_$#]*)*"
           r'|"[^"]*"|:=|<=|>=|<>|!=|\|\||[^\s\p{L}\p{N}_])' "'")
    cls = (f"list_transform(regexp_extract_all({norm_expr}, {pat}, 1), lambda t: case "
           f"when starts_with(t, '''') then '<STRING>' when regexp_matches(t, '^\\.?\\d') then '<NUMBER>' "
           f"when list_contains({kw}, upper(t)) then upper(t) "
           f"when regexp_matches(t, '^[\\p{{L}}_\"]') then '<IDENTIFIER>' else t end)")
    return f"sha256(array_to_string({cls}, ' '))"


@register("normalize_code_oracle", sql=f"""
select c_custkey, {_duck_regex_chain(ORACLE_CODE_SQL, 'oracle')} as normalized from customer
""")
def normalize_code_oracle_q(spark, sf):
    from ..functions.code import normalize_code
    c = table(spark, sf, "customer")
    return c.select("c_custkey", normalize_code(F.expr(ORACLE_CODE_SQL), "oracle").alias("normalized"))


@register("normalize_code_postgres", sql=f"""
select c_custkey, {_duck_regex_chain(POSTGRES_CODE_SQL, 'postgres')} as normalized from customer
""")
def normalize_code_postgres_q(spark, sf):
    from ..functions.code import normalize_code
    c = table(spark, sf, "customer")
    return c.select("c_custkey", normalize_code(F.expr(POSTGRES_CODE_SQL), "postgres").alias("normalized"))


@register("code_fingerprint_groups", sql=f"""
select dialect, fingerprint, cast(count(*) as bigint) as n from (
  select 'oracle' as dialect, {_duck_fingerprint(_duck_regex_chain(ORACLE_CODE_SQL, 'oracle'), 'oracle')} as fingerprint from customer
  union all
  select 'postgres', {_duck_fingerprint(_duck_regex_chain(POSTGRES_CODE_SQL, 'postgres'), 'postgres')} from customer)
group by dialect, fingerprint
""")
def code_fingerprint_groups_q(spark, sf):
    from ..functions.code import code_fingerprint
    c = table(spark, sf, "customer")
    fp = (c.select(F.lit("oracle").alias("dialect"), code_fingerprint(F.expr(ORACLE_CODE_SQL), "oracle").alias("fingerprint"))
          .unionByName(c.select(F.lit("postgres").alias("dialect"),
                                code_fingerprint(F.expr(POSTGRES_CODE_SQL), "postgres").alias("fingerprint"))))
    return fp.groupBy("dialect", "fingerprint").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("exact_match_rate", sql=f"""
select dialect, cast(count(*) as bigint) as n, cast(sum(em) as bigint) as exact, round(sum(em) / count(*), 6) as em_rate from (
  select 'oracle' as dialect, case when {_duck_fingerprint(_duck_regex_chain(ORACLE_CODE_SQL, 'oracle'), 'oracle')}
       = {_duck_fingerprint(_duck_regex_chain(ORACLE_PRED_SQL, 'oracle'), 'oracle')} then 1 else 0 end as em from customer
  union all
  select 'postgres', case when {_duck_fingerprint(_duck_regex_chain(POSTGRES_CODE_SQL, 'postgres'), 'postgres')}
       = {_duck_fingerprint(_duck_regex_chain(POSTGRES_PRED_SQL, 'postgres'), 'postgres')} then 1 else 0 end from customer)
group by dialect
""")
def exact_match_rate_q(spark, sf):
    from ..functions.code import exact_match
    c = spread(table(spark, sf, "customer"))
    em = (c.select(F.lit("oracle").alias("dialect"),
                   exact_match(F.expr(ORACLE_CODE_SQL), F.expr(ORACLE_PRED_SQL), "oracle").alias("em"))
          .unionByName(c.select(F.lit("postgres").alias("dialect"),
                                exact_match(F.expr(POSTGRES_CODE_SQL), F.expr(POSTGRES_PRED_SQL), "postgres")
                                .alias("em"))))
    return em.groupBy("dialect").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                     F.sum("em").cast("long").alias("exact"),
                                     F.round(F.sum("em") / F.count(F.lit(1)), 6).alias("em_rate"))


# Procedures with nested blocks; the prediction departs from the gold one at a place
# that the customer's key decides, so the expected path is known without any parser.
NESTED_CODE_SQL = f"""concat('CREATE OR REPLACE PROCEDURE sp(a IN NUMBER, b IN NUMBER) IS BEGIN FOR i IN 1..', cast(c_nationkey as string),
 ' LOOP IF a > ', cast(c_custkey as string), ' THEN UPDATE t SET x = (a + (b * 2)); ELSE BEGIN DELETE FROM t WHERE x = ''it''''s ', c_mktsegment,
 '''; INSERT INTO t VALUES (1, .5, 1e5); END; END IF; END LOOP; x := CASE WHEN a = 1 THEN 2 ELSE 3 END; END;')"""
NESTED_PRED_SQL = f"""(case c_custkey % 8 when 0 then replace({NESTED_CODE_SQL}, 'x = ''it', 'x > ''it')
 when 1 then replace({NESTED_CODE_SQL}, '(b * 2)', '(b / 2)') when 2 then replace({NESTED_CODE_SQL}, 'INSERT INTO t VALUES (1, .5, 1e5); ', '')
 when 3 then replace({NESTED_CODE_SQL}, 'ELSE 3 END', 'END') when 4 then replace({NESTED_CODE_SQL}, 'END LOOP;', 'END LOOP; COMMIT;')
 when 5 then replace(replace({NESTED_CODE_SQL}, 'it''''s', 'its'), '.5, 1e5', '2, 3') when 6 then replace({NESTED_CODE_SQL}, ' t ', '   s ')
 else null end)"""


@register("code_first_difference", sql="""
with way as (select '1:STATEMENT/8:BEGIN/1:STATEMENT/7:LOOP/1:STATEMENT/1:IF' as branch)
select c_custkey, case when c_custkey % 8 in (5, 6) then 1 else 0 end as same,
  case c_custkey % 8 when 0 then branch || '/2:STATEMENT/2:BEGIN/1:STATEMENT/6:=' when 1 then branch || '/1:STATEMENT/10:(/1:STATEMENT/3:(/1:STATEMENT/2:*'
    when 2 then branch || '/2:STATEMENT/2:BEGIN/2:STATEMENT' when 3 then '1:STATEMENT/8:BEGIN/2:STATEMENT/3:CASE/1:STATEMENT/7:ELSE'
    when 4 then '1:STATEMENT/8:BEGIN/2:STATEMENT/1:<IDENTIFIER>' when 7 then '' end as first_difference
from customer, way
""")
def code_first_difference_q(spark, sf):
    from ..functions.code_tree import compare_code
    c = spread(table(spark, sf, "customer")).select("c_custkey", F.expr(NESTED_CODE_SQL).alias("gold"), F.expr(NESTED_PRED_SQL).alias("pred"))
    return compare_code(c, "gold", "pred").select("c_custkey", "same", "first_difference")


# One dump file per customer: a table, a commented-out insert (lost with its
# comment line, as in the reference), an update, and blank statements.
SCRIPT_FILE_SQL = "concat(lower(c_mktsegment), '-', cast(c_custkey as string), '.sqlite.sql')"
SCRIPT_SQL = ("concat('CREATE TABLE t_', cast(c_custkey as string), '(x INT); -- created', chr(10), "
              "'-- seed row', chr(10), 'INSERT INTO t_', cast(c_custkey as string), ' VALUES (', "
              "cast(c_nationkey as string), ');', chr(10), ' ; ', chr(10), "
              "'UPDATE t_', cast(c_custkey as string), ' SET x = x + 1;', chr(9))")


@register("split_scripts", sql=f"""
with s as (select {SCRIPT_FILE_SQL} as file, {SCRIPT_SQL} as content from customer),
p as (select file, list_filter(list_transform(string_split(content, ';'),
              lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not starts_with(x, '--')) as l from s)
select file, lower(substr(regexp_replace(regexp_replace(file, '(\\.sqlite\\.sql|\\.sql)$', ''), '[^a-zA-Z0-9_]', '_', 'g'), 1, 30)) as schema_name,
       cast(unnest(generate_series(1, len(l))) as integer) as stmt_pos, unnest(l) as stmt
from p
""")
def split_scripts_q(spark, sf):
    from ..functions.code import schema_name_from_path, split_statements
    c = table(spark, sf, "customer")
    s = c.select(F.expr(SCRIPT_FILE_SQL).alias("file"), F.expr(SCRIPT_SQL).alias("content"))
    return (s.select("file", schema_name_from_path("file").alias("schema_name"),
                     F.explode(split_statements("content")).alias("s"))
            .select("file", "schema_name", F.col("s.stmt_pos").cast("int").alias("stmt_pos"), "s.stmt"))


# ---------------------------------------------------------------------------
# Schema text and prompts (P3, P4, P5, P6, P11, J4): every order is a task
# whose schema has an orders and a customer table filled from its own rows.
# ---------------------------------------------------------------------------

def _order_schema(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    x = o.join(c, o.o_custkey == c.c_custkey)
    s = F.array().cast("array<string>")
    orders_item = F.struct(
        F.lit("orders").alias("table_name"), F.lit("").alias("table_comment"),
        F.array(F.lit("o_orderkey"), F.lit("o_orderstatus"), F.lit("o_orderpriority")).alias("column_names"),
        F.array(F.lit("NUMBER"), F.lit("VARCHAR2"), F.lit("VARCHAR2")).alias("column_types"),
        F.array(F.lit(""), F.lit(""), F.lit("priority class")).alias("column_comments"),
        F.array(F.array(F.col("o_orderkey").cast("string")), F.array(F.col("o_orderstatus")), s)
        .alias("column_contents"),
        F.array(F.lit(1), F.lit(0), F.lit(0)).alias("pk_indicators"))
    cust_item = F.struct(
        F.lit("customer").alias("table_name"), F.lit("buyers").alias("table_comment"),
        F.array(F.lit("c_custkey"), F.lit("c_mktsegment")).alias("column_names"),
        F.array(F.lit("NUMBER"), F.lit("VARCHAR2")).alias("column_types"),
        F.array(F.lit(""), F.lit("")).alias("column_comments"),
        F.array(s, F.array(F.col("c_mktsegment"))).alias("column_contents"),
        F.array(F.lit(1), F.lit(0)).alias("pk_indicators"))
    fks = F.array(F.array(F.lit("orders"), F.lit("o_custkey"), F.lit("customer"), F.lit("c_custkey")))
    return x.select("o_orderkey", F.struct(F.array(orders_item, cust_item).alias("schema_items"),
                                           fks.alias("foreign_keys")).alias("schema"))


_ORDER_SCHEMA_SQL = """('database schema :' || chr(10) ||
 'table orders , columns = [ o_orderkey ( NUMBER | primary key | values : ' || cast(o_orderkey as varchar) ||
 ' ) , o_orderstatus ( VARCHAR2 | values : ' || o_orderstatus || ' ) , o_orderpriority ( VARCHAR2 | comment : priority class ) ]' || chr(10) ||
 'table customer , columns = [ c_custkey ( NUMBER | primary key ) , c_mktsegment ( VARCHAR2 | values : ' || c_mktsegment || ' ) ]' || chr(10) ||
 'foreign keys :' || chr(10) || 'orders.o_custkey = customer.c_custkey')"""


@register("schema_sequence", sql=f"""
select o_orderkey, {_ORDER_SCHEMA_SQL} as schema_sequence,
       'orders,o_orderkey,o_orderstatus,o_orderpriority,customer,c_custkey,c_mktsegment' as terms
from orders join customer on o_custkey = c_custkey
""")
def schema_sequence_q(spark, sf):
    from ..functions.text import schema_terms
    from ..operators.prompts import schema_sequence
    x = _order_schema(spark, sf)
    return x.select("o_orderkey", schema_sequence("schema").alias("schema_sequence"),
                    F.array_join(schema_terms("schema.schema_items"), ",").alias("terms"))


def _doc_schema_seq():
    """Schema text of a one-table database describing a document row."""
    return F.concat(F.lit("database schema :\ntable documents , columns = [ doc_id ( NUMBER | primary key | values : "),
                    F.col("doc_id").cast("string"), F.lit(" ) , lang ( VARCHAR2 | values : "), F.col("lang"),
                    F.lit(" ) , source ( VARCHAR2 | comment : origin ) ]\nforeign keys : None"))


_DOC_SCHEMA_SQL = """('database schema :' || chr(10) || 'table documents , columns = [ doc_id ( NUMBER | primary key | values : '
 || cast(doc_id as varchar) || ' ) , lang ( VARCHAR2 | values : ' || lang || ' ) , source ( VARCHAR2 | comment : origin ) ]'
 || chr(10) || 'foreign keys : None')"""


def _cot_sql(text):
    from ..functions.text import COT_ORACLE, COT_POSTGRES
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"(case when contains(lower({text}), 'oracle') then {q(COT_ORACLE)} else {q(COT_POSTGRES)} end)"


@register("prompts", sql=_PAIRS_SQL + f"""
, r as (select eval_id, demo_id, row_number() over (partition by eval_id order by round(s1, 6) desc, demo_id) as rk from p),
k as (select * from r where rk <= 3),
shots as (select k.eval_id, string_agg(d.text || chr(10) || 'SELECT * FROM documents WHERE doc_id = ' ||
                 cast(d.doc_id as varchar) || ';' || chr(10) || chr(10), '' order by k.rk) as block
          from k join documents d on d.doc_id = k.demo_id group by k.eval_id),
t as (select doc_id as eval_id, text || case when doc_id % 3 = 0 then ' for Oracle' else '' end as text,
             {_DOC_SCHEMA_SQL} as schema_sequence, source from documents),
pr as (select t.eval_id,
              {_cot_sql('t.text')} || chr(10) || coalesce(s.block, '') || t.schema_sequence || chr(10) || t.text || chr(10) as few,
              t.schema_sequence || chr(10) || 'Skeleton: ' || t.source || chr(10) || t.text || chr(10) ||
              'Output the PL/SQL procedure. Begin with CREATE OR REPLACE PROCEDURE sp();' || chr(10) as zero
       from t left join shots s on s.eval_id = t.eval_id)
select eval_id, md5(few) as few_shot_md5, cast(length(few) as integer) as few_shot_len,
       md5(zero) as zero_shot_md5, cast(length(zero) as integer) as zero_shot_len from pr
""")
def prompts_q(spark, sf):
    from ..operators.prompts import few_shot_prompts, zero_shot_prompt
    emb = table(spark, sf, "embeddings")
    topk = topk_similar(emb.select(F.col("vec_id").alias("eval_id"), "embedding"),
                        emb.select(F.col("vec_id").alias("demo_id"), "embedding"), 3,
                        kinds=[Cosine("embedding")], exclude_self=True)
    docs = table(spark, sf, "documents")
    # every document is a task (one without a vector gets no demonstrations); a third mention Oracle
    asked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" for Oracle")).otherwise(F.lit("")))
    tasks = docs.select(F.col("doc_id").alias("eval_id"), asked.alias("text"), "source", _doc_schema_seq().alias("schema_sequence"))
    demos = docs.select(F.col("doc_id").alias("demo_id"), "text",
                        F.concat(F.lit("SELECT * FROM documents WHERE doc_id = "), F.col("doc_id").cast("string"),
                                 F.lit(";")).alias("plsql"))
    few = few_shot_prompts(tasks, topk, demos, cot=True)
    out = few.withColumn("zero", zero_shot_prompt("text", "schema_sequence", skeleton="source"))
    return out.select("eval_id", F.md5("prompt").alias("few_shot_md5"), F.length("prompt").alias("few_shot_len"),
                      F.md5("zero").alias("zero_shot_md5"), F.length("zero").alias("zero_shot_len"))


# ---------------------------------------------------------------------------
# Supervised examples (P2, P14, P15): a user turn is the prefix, the next
# assistant turn of the same conversation the target.
# ---------------------------------------------------------------------------

_TOK = "regexp_extract_all({t}, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])', 1)"


# A tokenizer that SQL can follow: a word's id comes from its first character and length.
_ID = "(3 + (ascii({w}) * 31 + length({w})) % 49149)"
_MAX = 8192


@register("training_examples", sql=f"""
with ids as (select conv_id, turn, role, list_transform({_TOK.format(t="coalesce(text, '')")}, lambda w: {_ID.format(w='w')}) as ids from conversations),
pairs as (select u.conv_id, u.turn, list_concat([1], u.ids) as p, list_concat(a.ids, [2]) as t, len(u.ids) as np
          from ids u join ids a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
x as (select *, len(p) + len(t) as n, list_concat(p, t) as joined, list_concat(list_transform(p, lambda i: -100), t) as lab from pairs),
ex as (select conv_id, turn, np,
  case when n <= {_MAX} then list_concat(joined, list_transform(range({_MAX} - n), lambda i: 0)) else list_concat([1], joined[n - {_MAX} + 2:]) end as input_ids,
  case when n <= {_MAX} then list_concat(lab, list_transform(range({_MAX} - n), lambda i: -100)) else lab[n - {_MAX} + 1:] end as labels,
  cast(least(n, {_MAX}) as integer) as mask_ones from x)
select conv_id, turn, mask_ones, md5(array_to_string(input_ids, ',')) as ids_md5, md5(array_to_string(labels, ',')) as labels_md5,
  cast(case when np > {_MAX} - 256 then {_MAX} - 256 else np end as integer) as prompt_len
from ex
""")
def training_examples_q(spark, sf):
    """P14 + P15 at the flow's own sizes: whole ids and labels."""
    from ..operators.prompts import sft_example, truncate_left
    from ..functions.text import WORD_OR_SYMBOL
    tok = lambda c: F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(WORD_OR_SYMBOL), 1),
                                lambda w: F.lit(3) + (F.ascii(w) * 31 + F.char_length(w)) % 49149)
    conv = table(spark, sf, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", tok("text").alias("p"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), tok("text").alias("t"))
    ex = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", sft_example("p", "t", _MAX, bos=1, eos=2, pad=0).alias("ex"),
                                               F.size(truncate_left("p", _MAX - 256, bos=[1])).alias("prompt_len"))
    joined = lambda c: F.md5(F.array_join(F.col(f"ex.{c}").cast("array<string>"), ","))
    return ex.select("conv_id", "turn", F.aggregate("ex.attention_mask", F.lit(0), lambda acc, x: acc + x).alias("mask_ones"),
                     joined("input_ids").alias("ids_md5"), joined("labels").alias("labels_md5"), "prompt_len")


# ---------------------------------------------------------------------------
# Foreign keys and matched contents after pruning (J5, J6): a customer task
# has one table per order and one customer table; every order table refers
# to the customer table.  Line items are columns; returned lines have
# matched values.
# ---------------------------------------------------------------------------

def _fk_tables(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    ot = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_pos"),
                  F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("table_name"),
                  F.col("o_totalprice").alias("prob"))
    ct = c.select(F.col("c_custkey").alias("task_id"), F.lit(-1).cast("long").alias("table_pos"),
                  F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("table_name"),
                  (F.col("c_acctbal") * 100).alias("prob"))
    fks = ot.select("task_id", F.col("table_name").alias("src_table"), F.lit("o_custkey").alias("src_col"),
                    F.concat(F.lit("customer_"), F.col("task_id").cast("string")).alias("dst_table"),
                    F.lit("c_custkey").alias("dst_col"))
    return ot.unionByName(ct), fks


_FK_TABLES_SQL = """
with tb as (select o_custkey as task_id, o_orderkey as table_pos, 'orders_' || cast(o_orderkey as varchar) as table_name,
                   o_totalprice as prob from orders
            union all
            select c_custkey, -1, 'customer_' || cast(c_custkey as varchar), c_acctbal * 100 from customer),
kt as (select * from (select *, row_number() over (partition by task_id order by prob desc, table_pos) as rk from tb)
       where rk <= 6)
"""


@register("filter_foreign_keys", sql=_FK_TABLES_SQL + """
select o.o_custkey as task_id, 'orders_' || cast(o.o_orderkey as varchar) as src_table, 'o_custkey' as src_col,
       'customer_' || cast(o.o_custkey as varchar) as dst_table, 'c_custkey' as dst_col
from orders o
where exists (select 1 from kt where kt.task_id = o.o_custkey and kt.table_name = 'orders_' || cast(o.o_orderkey as varchar))
  and exists (select 1 from kt where kt.task_id = o.o_custkey and kt.table_name = 'customer_' || cast(o.o_custkey as varchar))
""")
def filter_foreign_keys_q(spark, sf):
    from ..operators.schema_items import filter_foreign_keys, topk_per_group
    tables, fks = _fk_tables(spark, sf)
    kept = topk_per_group(tables, ["task_id"], "prob", "table_pos", 6).select("task_id", "table_name")
    return filter_foreign_keys(fks, kept)


@register("filter_matched_contents", sql=_FK_TABLES_SQL + """
, kc as (select kt.task_id, kt.table_name, 'l' || cast(l.l_pos as varchar) as column_name,
                row_number() over (partition by kt.task_id, kt.table_name order by l.l_extendedprice desc, l.l_pos) as crk
         from kt join LINES l on kt.table_name = 'orders_' || cast(l.l_orderkey as varchar)),
m as (select o.o_custkey as task_id, 'orders_' || cast(l.l_orderkey as varchar) || '.l' || cast(l.l_pos as varchar) as key,
             l.l_linestatus as val
      from LINES l join orders o on o.o_orderkey = l.l_orderkey where l.l_returnflag = 'R')
select task_id, key, val from m
where exists (select 1 from kc where kc.crk <= 3 and kc.task_id = m.task_id and kc.table_name || '.' || kc.column_name = m.key)
""")
def filter_matched_contents_q(spark, sf):
    from ..operators.schema_items import filter_matched_contents, topk_per_group
    tables, _ = _fk_tables(spark, sf)
    kept = topk_per_group(tables, ["task_id"], "prob", "table_pos", 6).select("task_id", "table_name", "table_pos")
    li = _lines(spark, sf)
    cols = (kept.join(li.select(F.col("l_orderkey").alias("table_pos"), "l_pos", "l_extendedprice"), "table_pos")
            .select("task_id", "table_name", F.concat(F.lit("l"), F.col("l_pos").cast("string")).alias("column_name"),
                    F.col("l_extendedprice").alias("prob"), F.col("l_pos").alias("col_pos")))
    kept_cols = topk_per_group(cols, ["task_id", "table_name"], "prob", "col_pos", 3)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id"))
    matched = (li.where(F.col("l_returnflag") == "R").join(o, li.l_orderkey == o.o_orderkey)
               .select("task_id",
                       F.concat(F.lit("orders_"), F.col("l_orderkey").cast("string"), F.lit(".l"),
                                F.col("l_pos").cast("string")).alias("key"),
                       F.col("l_linestatus").alias("val")))
    return filter_matched_contents(matched, kept_cols)


# ---------------------------------------------------------------------------
# Chunked scoring (W5, F3, J7, W4, P17) and name/token alignment (P16, J8,
# J9): a customer is a task (its name is the text), its orders are tables,
# its line items are columns.
# ---------------------------------------------------------------------------

def _cust_schema(spark, sf):
    from ..operators.schema_items import decorate_name
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("text"))
    o = table(spark, sf, "orders")
    tables = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_pos"),
                      F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("raw_name"),
                      F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.lit("")).alias("comment"),
                      "o_totalprice")
    tables = tables.withColumn("table_name", decorate_name("raw_name", "comment"))
    li = _lines(spark, sf)
    cols = (li.join(o.select("o_orderkey", F.col("o_custkey").alias("task_id")), li.l_orderkey == o.o_orderkey)
            .select("task_id", F.col("l_orderkey").alias("table_pos"), F.col("l_pos").alias("col_pos"),
                    F.concat(F.lit("l"), F.col("l_pos").cast("string")).alias("raw_name"),
                    F.when(F.col("l_returnflag") == "R", F.lit("returned item")).otherwise(F.lit("")).alias("comment"),
                    "l_extendedprice"))
    cols = cols.withColumn("column_name", decorate_name("raw_name", "comment"))
    return c, tables, cols


_CHUNK_SQL = """
with recursive
tx as (select c_custkey as task_id, c_name as text from customer),
tb as (select o_custkey as task_id, o_orderkey as table_pos, o_totalprice,
              'orders_' || cast(o_orderkey as varchar) ||
              case when o_orderstatus = 'F' then ' ( ' || o_orderpriority || ' ) ' else '' end as table_name
       from orders),
co as (select o.o_custkey as task_id, l.l_orderkey as table_pos, l.l_pos as col_pos,
              'l' || cast(l.l_pos as varchar) || case when l.l_returnflag = 'R' then ' ( returned item ) ' else '' end
              as column_name
       from LINES l join orders o on o.o_orderkey = l.l_orderkey),
it as (select co.task_id, co.table_pos, co.col_pos, co.column_name,
              len(regexp_extract_all(tb.table_name, '(\\S{1,4})', 1)) as tl,
              len(regexp_extract_all(co.column_name, '(\\S{1,4})', 1)) as cl,
              row_number() over (partition by co.task_id order by co.table_pos, co.col_pos) as i
       from co join tb on tb.task_id = co.task_id and tb.table_pos = co.table_pos),
bs as (select task_id, 2 + len(regexp_extract_all(text, '(\\S{1,4})', 1)) as b from tx
       where task_id in (select task_id from it)),
r as (
  select task_id, cast(0 as bigint) as i, 0 as chunk, 0 as n, b as len, cast(null as bigint) as cur, b from bs
  union all
  select r.task_id, r.i + 1,
         case when r.len + (case when r.cur = it.table_pos then it.cl + 1 else it.tl + 2 + it.cl end) < 40 or r.n = 0
              then r.chunk else r.chunk + 1 end,
         case when r.len + (case when r.cur = it.table_pos then it.cl + 1 else it.tl + 2 + it.cl end) < 40 or r.n = 0
              then r.n + 1 else 1 end,
         case when r.len + (case when r.cur = it.table_pos then it.cl + 1 else it.tl + 2 + it.cl end) < 40
              then r.len + (case when r.cur = it.table_pos then it.cl + 1 else it.tl + 2 + it.cl end)
              else r.b + it.tl + 2 + it.cl end,
         it.table_pos, r.b
  from r join it on it.task_id = r.task_id and it.i = r.i + 1),
ch as (select it.task_id, it.table_pos, it.col_pos, r.chunk as chunk_pos,
              list_distinct(list_filter(string_split(regexp_replace(lower(it.column_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '),
                                        lambda w: w <> '')) as nw
       from r join it on it.task_id = r.task_id and it.i = r.i),
tw as (select task_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '),
                                                 lambda w: w <> '')) as w from tx),
sc as (select ch.task_id, ch.table_pos, ch.col_pos, ch.chunk_pos,
              round(case when len(ch.nw) > 0 then len(list_intersect(ch.nw, tw.w)) / len(ch.nw) else 0 end
                    + ch.chunk_pos * 0.01, 6) as prob
       from ch join tw on tw.task_id = ch.task_id),
ctp as (select ct.task_id, ct.table_pos, max(round(tb.o_totalprice / 1e4 + ct.chunk_pos * 0.01, 6)) as table_prob
        from (select distinct task_id, chunk_pos, table_pos from sc) ct
        join tb on tb.task_id = ct.task_id and tb.table_pos = ct.table_pos group by ct.task_id, ct.table_pos),
cc as (select task_id, table_pos, string_agg(printf('%.6f', prob), ',' order by chunk_pos, col_pos, prob) as column_probs,
              count(*) as n_cols from sc group by task_id, table_pos),
m as (select tb.task_id, tb.table_pos, cast(coalesce(ctp.table_prob, 0.0) as double) as table_prob,
             coalesce(cc.column_probs, '') as column_probs, coalesce(cc.n_cols, 0) as n_cols
      from tb left join ctp on ctp.task_id = tb.task_id and ctp.table_pos = tb.table_pos
      left join cc on cc.task_id = tb.task_id and cc.table_pos = tb.table_pos)
select task_id, table_pos, table_prob, column_probs,
       cast(coalesce(sum(n_cols) over (partition by task_id order by table_pos
                                       rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
from m
"""


@register("merge_chunk_scores", sql=_CHUNK_SQL)
def merge_chunk_scores_q(spark, sf):
    """W5 + F3 + J7 + W4 + P17.  The greedy length budget is a sequential
    fold per task (an ``aggregate`` in Spark, a recursive CTE in the oracle;
    also checked against a Python loop in tests/test_schema_items.py)."""
    from ..operators.schema_items import budget_chunks, merge_chunk_scores, prefix_offsets, score_schema_items
    from ..session import cut_lineage
    texts, tables, cols = _cust_schema(spark, sf)
    # items feed the chunking and the scorer: derive them once
    items = cut_lineage(cols.join(tables.select("task_id", "table_pos", "table_name"), ["task_id", "table_pos"]))
    chunks = budget_chunks(items, texts, budget=40)
    # F3 default scorer on the chunked items, made chunk-dependent on purpose
    scored = score_schema_items(
        chunks.join(items.select("task_id", "table_pos", "col_pos", F.col("column_name").alias("name")),
                    ["task_id", "table_pos", "col_pos"]), texts)
    chunk_cols = scored.withColumn("prob", F.round(F.col("prob") + F.col("chunk_pos") * 0.01, 6))
    chunk_tables = (chunk_cols.select("task_id", "chunk_pos", "table_pos").distinct()
                    .join(tables.select("task_id", "table_pos", "o_totalprice"), ["task_id", "table_pos"])
                    .select("task_id", "chunk_pos", "table_pos",
                            # price / 1e4 has exactly 6 decimals: no half-way rounding cases
                            F.round(F.col("o_totalprice") / 1e4 + F.col("chunk_pos") * 0.01, 6).alias("prob")))
    merged = merge_chunk_scores(tables.select("task_id", "table_pos"), chunk_tables, chunk_cols)
    counts = merged.select("task_id", "table_pos", F.size("column_probs").alias("n_cols"))
    offs = prefix_offsets(counts, ["task_id"], "table_pos", "n_cols")
    return (merged.join(offs, ["task_id", "table_pos"])
            .select("task_id", "table_pos", "table_prob",
                    F.array_join(F.transform("column_probs", lambda p: F.format_number(p, 6)), ",").alias("column_probs"),
                    "offset"))


_SPAN_SQL = """
with tk as (select c_custkey as task_id, len(regexp_extract_all(c_name, '(\\S{1,4})', 1)) as tn from customer),
tb as (select o_custkey as task_id, o_orderkey as table_pos,
              'orders_' || cast(o_orderkey as varchar) ||
              case when o_orderstatus = 'F' then ' ( ' || o_orderpriority || ' ) ' else '' end as name from orders),
tb2 as (select *, len(regexp_extract_all(name, '(\\S{1,4})', 1)) as tl from tb),
cl as (select o.o_custkey as task_id, l.l_orderkey as table_pos, l.l_pos as col_pos,
              len(regexp_extract_all('l' || cast(l.l_pos as varchar) ||
                  case when l.l_returnflag = 'R' then ' ( returned item ) ' else '' end, '(\\S{1,4})', 1)) as cl
       from LINES l join orders o on o.o_orderkey = l.l_orderkey),
cs as (select task_id, table_pos, sum(cl) as scl, count(*) as nc from cl group by task_id, table_pos),
tl3 as (select tb2.task_id, tb2.table_pos, tb2.tl,
               1 + tb2.tl + case when cs.nc > 0 then 1 + cs.scl + cs.nc - 1 else 0 end as wl
        from tb2 left join cs on cs.task_id = tb2.task_id and cs.table_pos = tb2.table_pos),
ts as (select tl3.*, tk.tn + coalesce(sum(wl) over (partition by tl3.task_id order by tl3.table_pos
                                      rows between unbounded preceding and 1 preceding), 0) as ot
       from tl3 join tk on tk.task_id = tl3.task_id),
names as (
  select task_id, table_pos, -1 as col_pos, 1 + ot + 1 as first_token, tl as n from ts
  union all
  select cl.task_id, cl.table_pos, cl.col_pos,
         1 + ts.ot + 1 + ts.tl + 1 + coalesce(sum(cl.cl + 1) over (partition by cl.task_id, cl.table_pos order by cl.col_pos
                                              rows between unbounded preceding and 1 preceding), 0),
         cl.cl
  from cl join ts on ts.task_id = cl.task_id and ts.table_pos = cl.table_pos),
spans as (select task_id, table_pos, cast(col_pos as bigint) as col_pos, cast(first_token as bigint) as first_token,
                 cast(greatest(least(n, 511 - first_token), 0) as integer) as n_tokens from names)
"""


@register("word_token_alignment", sql=_SPAN_SQL + "select * from spans where n_tokens > 0")
def word_token_alignment_q(spark, sf):
    from ..operators.schema_items import name_token_spans
    texts, tables, cols = _cust_schema(spark, sf)
    return name_token_spans(texts, tables.select("task_id", "table_pos", "table_name"),
                            cols.select("task_id", "table_pos", "col_pos", "column_name"), max_length=512)


@register("realign_counts", sql=_SPAN_SQL + """
select task_id, table_pos, cast(count(*) as integer) as n_columns from spans
where n_tokens > 0 and col_pos >= 0 group by task_id, table_pos
""")
def realign_counts_q(spark, sf):
    from ..operators.schema_items import realign_counts
    return realign_counts(word_token_alignment_q(spark, sf))


def _expand_lines_alias():
    """Queries above write ``LINES l`` for line items with their l_pos."""
    from .registry import _QUERIES
    for q in _QUERIES.values():
        if q.sql and "LINES l" in q.sql:
            q.sql = q.sql.replace("LINES l", LINES_SQL + " l")


_expand_lines_alias()


# ---------------------------------------------------------------------------
# Rows-only queries (no SQL oracle; brute-force checks in tests/)
# ---------------------------------------------------------------------------

@register("skeleton_tree_similarity")
def skeleton_tree_similarity_q(spark, sf):
    """P13 + F4 + J2 + A2: block trees of every customer's procedure, the
    3 most similar other procedures by normalised tree edit distance."""
    from ..functions.code import code_skeleton
    from ..functions.skeleton import skeleton_tree
    from ..operators.retrieval import TreeDistance
    from ..session import cut_lineage
    c = table(spark, sf, "customer")
    # the trees are read by the size probe, the eval collect and two demo
    # passes: derive them once
    trees = cut_lineage(c.select(F.col("c_custkey").alias("id"),
                                 skeleton_tree(code_skeleton(F.expr(ORACLE_CODE_SQL), "oracle")).alias("tree")))
    return topk_similar(trees.withColumnRenamed("id", "eval_id"), trees.withColumnRenamed("id", "demo_id"), 3,
                        kinds=[TreeDistance("tree")], mode="weighted", weights=[1.0], exclude_self=True)


def _word_lexicon(docs):
    """Caller-side lexicon stand-in: words seen in at most two documents are
    tagged NN (content words); the others get no masking tag."""
    from ..functions.text import WORD_OR_SYMBOL
    w = docs.select("doc_id", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(WORD_OR_SYMBOL), 1))).alias("word"))
    return (w.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
            .select("word", F.when(F.col("df") <= 2, F.lit("NN")).otherwise(F.lit("DT")).alias("tag")))


_WORD = r"'([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])'"


def _cosine_sql(name: str, column: str) -> str:
    """CTEs that end in ``<name>``(eval_id, demo_id, s): TF-IDF cosines of a column of
    ``d`` (pool) and ``b`` (queries)."""
    return f"""
{name}_t as (select side, id, token, count(*) as n from (
    select side, id, unnest(regexp_extract_all(lower({column}), {_WORD}, 1)) as token from sides) group by all),
{name}_i as (select token, ln(((select count(*) from documents) + 1.0) / (count(*) + 1.0)) as idf from {name}_t where side = 'd' group by token),
{name}_w as (select side, id, token, n * coalesce(idf, ln((select count(*) from documents) + 1.0)) as w from {name}_t left join {name}_i using (token)),
{name}_n as (select side, id, sqrt(sum(w * w)) as norm from {name}_w group by all),
{name}_d as (select e.id as eval_id, d.id as demo_id, sum(e.w * d.w) as dot from {name}_w e join {name}_w d using (token)
             where e.side = 'b' and d.side = 'd' group by all),
{name} as (select e.id as eval_id, d.id as demo_id,
                  case when e.norm > 0 and d.norm > 0 then coalesce(dot, 0) / (e.norm * d.norm) end as s
           from (select s.id, norm from sides s left join {name}_n n on n.side = s.side and n.id = s.id where s.side = 'b') e
           cross join (select s.id, norm from sides s left join {name}_n n on n.side = s.side and n.id = s.id where s.side = 'd') d
           left join {name}_d x on x.eval_id = e.id and x.demo_id = d.id)"""


_TEXT_SKELETON_SQL = rf"""
with words as (select doc_id, unnest(list_distinct(regexp_extract_all(text, {_WORD}, 1))) as word from documents),
lex as (select word, case when count(*) <= 2 then 'NN' else 'DT' end as tag from words group by word),
raw as (select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
toks as (select side, id, unnest(t) as tok, unnest(range(len(t))) as pos from (
  select side, id, regexp_extract_all(text, '(''s|''''|--|[\p{{L}}\p{{N}}_]+(?:\.[\p{{N}}]+)?|[^\p{{L}}\p{{N}}_\s])', 1) as t from raw)),
shown as (select side, id, pos, case when regexp_matches(tok, '^\p{{N}}') then '_' when lex.tag = 'NN' then '_'
                                     when tok in ('$', '''''', '(', ')', ',', '--', '.', ':') then null else tok end as w
          from toks left join lex on lex.word = tok),
skels as (select side, id, regexp_replace(regexp_replace(replace(replace(string_agg(w, ' ' order by pos), '_ ''s', '_'), ' ''s', '''s'),
                 '_( _)+', '_', 'g'), '^_ ', '') as skel from shown where w is not null group by all),
sides as (select raw.side, raw.id, raw.text, coalesce(skel, '') as skel from raw left join skels on skels.side = raw.side and skels.id = raw.id),
{_cosine_sql('c1', 'text')},
{_cosine_sql('c2', 'skel')},
p as (select c1.eval_id, c1.demo_id, round(case when c1.s is null or c2.s is null then null else greatest(c1.s, c2.s) end, 6) as sim
      from c1 join c2 on c1.eval_id = c2.eval_id and c1.demo_id = c2.demo_id),
r as (select *, row_number() over (partition by eval_id order by sim desc nulls last, demo_id) as rk from p)
select eval_id, cast(rk as integer) as rank, demo_id, sim from r where rk <= 3
"""


# Trees of one level: the root's children are a name's letters, all of size 1, so the
# tree distance is the Levenshtein distance.
@register("tree_distance_topk", sql="""
with d as (select n_nationkey as eval_id, p_partkey as demo_id, levenshtein(lower(n_name), lower(p_name || ' ' || p_brand)) as d from nation, part),
s as (select eval_id, demo_id, round((max(d) over () - d) / (max(d) over () - min(d) over ()), 6) as sim from d)
select eval_id, cast(row_number() over (partition by eval_id order by sim desc, demo_id) as integer) as rank, demo_id, sim
from s qualify rank <= 5
""")
def tree_distance_topk_q(spark, sf):
    """J2 + A2 + W1: the part names with the nearest letter trees to each nation's name."""
    from ..operators.retrieval import TreeDistance
    letters = lambda c: F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""),
                                    lambda x: F.struct(F.lit(0).alias("depth"), x.alias("value")))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("eval_id"), letters(F.col("n_name")).alias("tree"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("demo_id"), letters(F.concat("p_name", F.lit(" "), "p_brand")).alias("tree"))
    return topk_similar(nations, parts, 5, kinds=[TreeDistance("tree")])


@register("text_skeleton_topk", sql=_TEXT_SKELETON_SQL)
def text_skeleton_topk_q(spark, sf):
    """P7 + F2 + J1 + A3(max) + W1: benchmark items retrieve documents by
    the larger of text and question-skeleton TF-IDF cosine similarity."""
    from ..functions.skeleton import question_skeleton
    from ..operators.packing import keys_repeat
    from ..operators.retrieval import SparseCosine, tfidf_vectors
    from ..llm.frames import kept_table, noted_tables, remove_tables
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bench = table(spark, sf, "benchmark").select("item_id", "text")
    both = (docs.select(F.concat(F.lit("d:"), F.col("doc_id")).alias("row_key"), F.col("doc_id").alias("id"), "text")
            .unionByName(bench.select(F.concat(F.lit("b:"), F.col("item_id")).alias("row_key"), F.col("item_id").alias("id"), "text")))
    with noted_tables() as passing:
        skeletons = question_skeleton(both, "text", _word_lexicon(docs), out="skel", key="row_key")
    with noted_tables() as last:
        sk = kept_table(skeletons, "skeletons", lean=True)
    remove_tables(spark, passing)
    pool, repeated = sk.where(F.col("row_key").startswith("d:")), keys_repeat(sk, "row_key")
    with noted_tables() as passing:
        weighed = tfidf_vectors(sk, "text", "v_text", key="row_key", fit_on=pool, carried=["row_key", "id", "skel"], repeated=repeated)
    with noted_tables() as codes:
        weighed = tfidf_vectors(weighed, "skel", "v_skel", key="row_key", fit_on=pool, carried=["row_key", "id", "v_text"], repeated=repeated)
    if codes:  # they hold the texts' vectors, too
        remove_tables(spark, passing)
    vec = kept_table(weighed, "vectors", lean=True)
    remove_tables(spark, [*last, *codes])
    sides = [vec.where(F.col("row_key").startswith(s)).withColumnRenamed("id", name) for s, name in (("b:", "eval_id"), ("d:", "demo_id"))]
    return topk_similar(*sides, 3, kinds=[SparseCosine("v_text"), SparseCosine("v_skel")], mode="max")


_RAW_CAND_SQL = ("('CREATE OR REPLACE PROCEDURE update_acct ( c_custkey IN NUMBER , v_bal IN NUMBER ) IS BEGIN "
                 "UPDATE customer SET c_acctbal = v_bal WHERE c_custkey = c_custkey AND c_acctbal > = ' || "
                 "printf('%.2f', c_acctbal) || ' AND c_name < > ''x'' ; v_bal : = 0 . 5 ; END; trailing words after the end')")
_TERMS_SQL = "['customer', 'c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']"

_CLEAN_SQL = f"""
with raw as (select c_custkey, {_RAW_CAND_SQL} as code from customer),
cut as (select c_custkey, case when strpos(code, 'END;') > 0 then substr(code, 1, strpos(code, 'END;') + 3)
                          else code end as code from raw),
tk as (select c_custkey, regexp_extract_all(code, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])', 1) as t from cut),
q as (select c_custkey, list_transform(t, lambda x: case when list_contains({_TERMS_SQL}, x) then '"' || x || '"' else x end)
             as q from tk),
nm as (select c_custkey, list_transform(q, lambda x, i: case
          when i >= 2 and i <= len(q) - 1 and lower(q[i - 1]) in ('procedure', 'function') and q[i + 1] = '('
          then 'sp' else x end) as n from q),
uq as (select c_custkey, list_transform(n, lambda x, i: case
          when list_contains(n[coalesce(i - list_position(list_reverse(n[1:i]), ')') + 1, 0) + 1:i], 'sp')
           and list_contains(n[coalesce(i - list_position(list_reverse(n[1:i]), ')') + 1, 0) + 1:i], '(')
          then replace(x, '"', '') else x end) as u from nm),
gl as (select c_custkey, u,
              regexp_replace(' ' || array_to_string(u[1:len(u) - 1], ' '),
                             ' (?:([=<>!:]) (=)|(<) (>)|(\\|) (\\|))', ' \\1\\2\\3\\4\\5\\6 ', 'g') as head
       from uq),
j as (select c_custkey, substr(case when len(u) = 0 then ''
                                    when len(u) = 1 then ' ' || u[1]
                                    else head || ' ' || u[len(u)] end, 2) as txt from gl),
tr as (select c_custkey, regexp_replace(' ' || txt || ' ', ' '' % ''(?: |$)', ' ''%''   ', 'g') as txt from j)
select c_custkey,
       regexp_replace(regexp_replace(regexp_replace(substr(txt, 2, length(txt) - 2), '" +"', '"', 'g'),
                                     '(\\d+)\\s*\\.\\s*(\\d+)', '\\1.\\2', 'g'),
                      '"\\s*(.*?)\\s*"', '"\\1"', 'g') as cleaned
from tr
"""


@register("clean_candidates", sql=_CLEAN_SQL)
def clean_candidates_q(spark, sf):
    """P11 + P12: procedures written with unquoted names, a renamed
    procedure, split operators and trailing text are cleaned against the
    customer schema terms (checked against a Python loop in tests/)."""
    from ..functions.code import clean_candidate
    c = spread(table(spark, sf, "customer"))
    raw = F.concat(
        F.lit("CREATE OR REPLACE PROCEDURE update_acct ( c_custkey IN NUMBER , v_bal IN NUMBER ) IS BEGIN "
              "UPDATE customer SET c_acctbal = v_bal WHERE c_custkey = c_custkey AND c_acctbal > = "),
        F.regexp_replace(F.format_number(F.col("c_acctbal"), 2), ",", ""),
        F.lit(" AND c_name < > 'x' ; v_bal : = 0 . 5 ; END; trailing words after the end"))
    terms = F.array(*[F.lit(x) for x in ["customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"]])
    return c.select("c_custkey", clean_candidate(raw, terms, "oracle").alias("cleaned"))


@register("catalog_profile", sql="""
with a as (select o_orderkey, o_totalprice, o_orderpriority from orders),
b as (select o_orderkey, case when o_orderkey % 2 = 1 then o_totalprice * 2 else o_totalprice end as o_totalprice,
             case when o_orderpriority <> '1-URGENT' then o_orderpriority end as o_orderpriority from orders),
fa as (select 'o_orderkey' as column_name, count(*) as n, count(*) - count(o_orderkey) as n_null, min(o_orderkey)::double as low, max(o_orderkey)::double as high, null as first_text from a
  union all select 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), null from a
  union all select 'o_orderpriority', count(*), count(*) - count(o_orderpriority), null, null, min(o_orderpriority) from a),
fb as (select 'o_orderkey' as column_name, count(*) as n, count(*) - count(o_orderkey) as n_null, min(o_orderkey)::double as low, max(o_orderkey)::double as high, null as first_text from b
  union all select 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), null from b
  union all select 'o_orderpriority', count(*), count(*) - count(o_orderpriority), null, null, min(o_orderpriority) from b)
select column_name, fb.n as n_rows, fb.n_null, round(fb.low, 6) as low, round(fb.high, 6) as high, fb.first_text,
  fa.low is distinct from fb.low or fa.high is distinct from fb.high or fa.first_text is distinct from fb.first_text as range_changed,
  abs(fa.n_null / fa.n - fb.n_null / fb.n) > 0.05 as nulls_changed
from fa join fb using (column_name)
""")
def catalog_profile_q(spark, sf):
    """S7 + J11 on data: the columns of orders before and after a change, profiled in one
    pass each and compared."""
    from ..sources.profile import drift, profile
    from ..session import cut_lineage
    before = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    after = before.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))) \
                  .withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")))
    a, b = (cut_lineage(profile({"orders": df})) for df in (before, after))
    changes = drift(a, b).select("column_name", F.array_contains("changed", "range").alias("range_changed"), F.array_contains("changed", "nulls").alias("nulls_changed"))
    return b.select("column_name", "n_rows", "n_null", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "first_text").join(changes, "column_name")


@register("catalog_diff", sql="""
with cols as (select distinct table_name, column_name, cast(ordinal_position as integer) as ordinal, data_type
              from information_schema.columns),
a as (select * from cols where table_name in ('orders', 'lineitem', 'customer', 'nation')),
b as (select table_name, column_name, ordinal,
             case when table_name = 'orders' and column_name = 'o_totalprice' then 'VARCHAR' else data_type end as data_type
      from cols where table_name in ('orders', 'lineitem', 'customer', 'part'))
select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.column_name, b.column_name) as column_name,
       a.table_name is not null as in_a, b.table_name is not null as in_b,
       coalesce(a.ordinal = b.ordinal and a.data_type = b.data_type, false) as same
from a full outer join b on a.table_name = b.table_name and a.column_name = b.column_name
""")
def catalog_diff_q(spark, sf):
    """S7 + J11 + L6: catalogs (table, column, type) of the before/after
    snapshots compared by a null-safe full outer join, in ORDER BY 1 order."""
    from ..operators.snapshots import compare_catalogs, order_by_first
    from ..sources.catalog import table_catalog
    before, after, _ = _snapshots(spark, sf)
    after = dict(after)
    after["orders"] = after["orders"].withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    cat_a = table_catalog(spark, before)
    cat_b = table_catalog(spark, after)
    return order_by_first(compare_catalogs(cat_a, cat_b))
