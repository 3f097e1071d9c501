"""Queries over the driver's tables that write with a sink, read back with its
source, and use the operators on the result.  Files go to a new folder below the
session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .registry import register, table


def _folder(spark, purpose: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@register("corpus_files", sql="""
select doc_id as row_id, case when lang = 'en' then 'sql' else 'text2code' end as corpus,
       md5(regexp_replace(case when lang = 'en' then text else text || chr(10) || source end, '^\\s+|\\s+$', '', 'g')) as text_md5
from documents
""")
def corpus_files(spark, sf):
    """S2 + P1: documents written as JSON lines of two kinds and read as corpora."""
    from ..sources.corpus import read_corpus
    docs, out = table(spark, sf, "documents"), _folder(spark, "corpora")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    docs.where(english).select("doc_id", F.col("text").alias("sql")).write.json(f"{out}/sql")
    docs.where(~english).select("doc_id", "text", F.col("source").alias("code")).write.json(f"{out}/text2code")
    parts = [read_corpus(spark, f"{out}/{kind}", kind, id_col="doc_id") for kind in ("sql", "text2code")]
    return parts[0].unionByName(parts[1]).select("row_id", "corpus", F.md5("text").alias("text_md5"))


@register("task_files", sql="""
select o_custkey as task_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as table_pos,
       'orders_' || o_orderkey as table_name, o_orderstatus as column_name, o_orderpriority as column_type from orders
""")
def task_files(spark, sf):
    """One task record for each customer, written as JSON lines and read back as
    long tables."""
    from ..sources.tasks import read_tasks, schema_columns
    o, out = table(spark, sf, "orders"), _folder(spark, "tasks")
    item = F.struct("o_orderkey", F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("table_name"),
                    F.array("o_orderstatus").alias("column_names"), F.array("o_orderpriority").alias("column_types"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("o_orderkey"))
    tasks = o.groupBy(F.col("o_custkey").alias("task_id")).agg(F.struct(items.alias("schema_items")).alias("schema"))
    tasks.write.json(out)
    return schema_columns(read_tasks(spark, out, "lines")).select("task_id", "table_pos", "table_name", "column_name", "column_type")


@register("token_block_files", sql="""
with l as (select (row_number() over (order by l_orderkey, l_linenumber, l_partkey) - 1) as place, l_partkey % 65536 as id from lineitem),
b as (select place // 1024 as block_id, string_agg(cast(id as varchar), ',' order by place) as labels, cast(count(*) as bigint) as mask_sum from l group by 1)
select block_id, md5(labels) as labels_md5, mask_sum from b where mask_sum = 1024
""")
def token_block_files(spark, sf):
    """S3 + S4 + W6: all line items as one stream of ids, cut into blocks of 1,024, written
    and read with the one partial block at the end dropped."""
    from ..operators.prefix import exclusive_prefix_sums
    from ..sources.blocks import read_token_blocks, write_token_blocks
    out = _folder(spark, "blocks")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1).cast("long").alias("one"))
    placed = exclusive_prefix_sums(lines, ["l_orderkey", "l_linenumber", "l_partkey"], ["one"]).withColumn("at", F.col("one_before"))
    token = F.struct("at", (F.col("l_partkey") % 65536).cast("int").alias("id"))
    blocks = placed.groupBy(F.floor(F.col("at") / 1024).alias("block_id")).agg(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["id"]).alias("input_ids"))
    write_token_blocks(blocks, out)
    return read_token_blocks(spark, out, block_size=1024).select(
        "block_id", F.md5(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("labels_md5"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


@register("cached_column", sql="select doc_id, upper(source) as shouted from documents")
def cached_column(spark, sf):
    """A derived column computed for half the documents first; the second call
    computes the missing ones only."""
    from ..sources.cache import materialize_missing
    docs, out = table(spark, sf, "documents").select("doc_id", "source"), _folder(spark, "cache")
    shout = lambda todo: todo.select("key", F.upper("source").alias("shouted"))
    materialize_missing(docs.where("doc_id % 2 = 0"), "source", shout, out, "shouted")
    return materialize_missing(docs, "source", shout, out, "shouted").select("doc_id", "shouted")


@register("snapshot_files", sql="""
with changed as (select * replace (o_totalprice + case when o_orderkey % 1000 = 1 then 1 else 0 end as o_totalprice) from orders),
away as (select (select count(*) from (select * from orders except all select * from changed)) + (select count(*) from (select * from changed except all select * from orders)) as n)
select 'nation' as table_name, case when count(*) >= 0 then 'missing_b' end as status from nation
union all select 'orders', case when n > 0 then 'differs' else 'same' end from away
union all select 'region', case when count(*) > 0 then 'differs' else 'same' end from (select * from region except all select * from region)
""")
def snapshot_files(spark, sf):
    """S8 + J10: the tables of a folder against a changed copy of it."""
    from ..operators.snapshots import compare_snapshots
    from ..sources.catalog import read_snapshot
    names, out = ["missing", "nation", "orders", "region"], _folder(spark, "snapshot")
    table(spark, sf, "region").repartition(3).write.parquet(f"{out}/region")
    table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 1000 == 1, 1).otherwise(0)) \
        .write.parquet(f"{out}/orders")
    return compare_snapshots(spark, read_snapshot(spark, sf, names), read_snapshot(spark, out, names), names).select("table_name", "status")


@register("similarity_files", sql="""
with x as (select o_custkey as eval_id, o_orderkey as demo_id, o_totalprice as sim, cast(o_orderkey % 97 as double) as dist from orders),
n as (select eval_id, demo_id, (sim - min(sim) over ()) / (max(sim) over () - min(sim) over ()) as a,
             (max(dist) over () - dist) / (max(dist) over () - min(dist) over ()) as b from x)
select eval_id, demo_id, round(0.25 * a + 0.75 * b, 6) as fused, round(greatest(a, b), 6) as larger from n
""")
def similarity_files(spark, sf):
    """S6 + A1 + A2 + A3 on pair tables: written, read, normalised, fused."""
    from ..operators.retrieval import fuse_pairs, minmax_normalize
    from ..sources.similarity_sink import read_similarity, write_similarity
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("eval_id"), F.col("o_orderkey").cast("long").alias("demo_id"),
                                          "o_totalprice")
    sides = []
    for name, value, distance in (("a", F.col("o_totalprice"), False), ("b", (F.col("demo_id") % 97).cast("double"), True)):
        out = _folder(spark, "pairs")
        write_similarity(o.select("eval_id", "demo_id", value.alias("sim")), out)
        sides.append(minmax_normalize(read_similarity(spark, out), "sim", name, distance=distance).drop("sim"))
    keys = ["eval_id", "demo_id"]
    fused = fuse_pairs(*sides, keys, "a", "b", w=0.25, out="fused").select(*keys, F.round("fused", 6).alias("fused"))
    larger = fuse_pairs(*sides, keys, "a", "b", mode="max", out="larger").select(*keys, F.round("larger", 6).alias("larger"))
    return fused.join(larger, keys)


@register("ordered_flags", sql="""
with l as (select l_orderkey, list(l_returnflag || l_linestatus order by l_linenumber, l_partkey) as f from lineitem group by l_orderkey)
select l_orderkey, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') as flags,
       cast(list_has_all(f, ['AF', 'RF']) as integer) as has_both, o_orderstatus
from l join orders on o_orderkey = l_orderkey
""")
def ordered_flags(spark, sf):
    """L5 + U3 + J3: distinct line flags of an order in first-seen order, aligned with
    the orders."""
    from ..operators.candidates import align
    from ..operators.metrics import contains_all
    from ..operators.packing import ordered_distinct
    line = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("f"))
    flags = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["f"])
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(flags.alias("f"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus") \
        .join(lines.select("l_orderkey"), "l_orderkey", "left_semi")
    return align(lines, orders, "l_orderkey").select(
        "l_orderkey", F.array_join(ordered_distinct("f"), ",").alias("flags"),
        contains_all(F.col("f"), F.array(F.lit("AF"), F.lit("RF"))).alias("has_both"), "o_orderstatus")
