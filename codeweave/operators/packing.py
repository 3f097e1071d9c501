"""Pre-training corpus build: tokenise (P2), mix with weights (U1), count
tokens (A8), pack into fixed blocks (W6), shards and batches (L3, L4, L5).

The global token order is (corpus position, copy, row id).  Offsets come
from the range-parallel prefix sum in ``prefix.py``; each document is cut
at block borders into at most ceil(len/B)+1 slices (never exploded to single
tokens) and the slices are regrouped by block id, so no group is ever larger
than one block.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_OR_SYMBOL
from .prefix import exclusive_prefix_sums

Tokenizer = Callable[[Column], Column]

# ids 0..2 are reserved (pad, bos, eos) by the default hashed tokenizer
PAD_ID, BOS_ID, EOS_ID = 0, 1, 2
DEFAULT_VOCAB = 49152
DECODED_ROWS = 1000  # rows handed back at once


def hashed_tokenizer(vocab_size: int = DEFAULT_VOCAB) -> Tokenizer:
    """Default F1 tokenizer: words / single symbols, id = 3 + hash mod V.
    Runs on the JVM, needs no vocabulary pass and no shuffle."""
    def tok(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(WORD_OR_SYMBOL), 1)
        return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(vocab_size - 3)) + 3).cast("int"))
    return tok


def pretrained_tokenizer(tokenizer_json: str) -> Tokenizer:
    """F1 plug point for a real subword tokenizer (a ``tokenizers`` JSON
    file): an Arrow-batched pandas UDF; the file is loaded once per worker."""
    from pyspark.sql.functions import pandas_udf

    state: dict = {}

    @pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if "tk" not in state:
            from tokenizers import Tokenizer as _Tk
            state["tk"] = _Tk.from_file(tokenizer_json)
        enc = state["tk"].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([e.ids for e in enc])

    return lambda text: encode(text)


def tokenize(df: DataFrame, text: str = "text", tokenizer: Tokenizer | None = None,
             eos_id: int = EOS_ID) -> DataFrame:
    """Ids of the text with EOS appended, and their count ``length``."""
    tok = tokenizer or hashed_tokenizer()
    ids = F.concat(tok(F.col(text)), F.array(F.lit(eos_id)))
    return df.withColumn("input_ids", ids).withColumn("length", F.size("input_ids"))


def mix_corpora(parts: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """Ordered concatenation; a weight w repeats the corpus w times (the
    reference lists one corpus twice).  Adds ``corpus``, ``corpus_pos`` and
    ``copy`` so that (corpus_pos, copy, row_id) is the global order."""
    out = None
    for pos, (name, df, weight) in enumerate(parts):
        part = (df.withColumn("corpus", F.lit(name)).withColumn("corpus_pos", F.lit(pos))
                .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(weight))))))
        out = part if out is None else out.unionByName(part)
    return out


def token_totals(df: DataFrame, corpus: str = "corpus", length: str = "length") -> DataFrame:
    """Documents and tokens per corpus plus a grand total row
    (``corpus`` NULL), copies counted."""
    return (df.rollup(corpus).agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                                  F.sum(length).cast("long").alias("n_tokens")))


def token_offsets(df: DataFrame, row_id: str = "row_id", length: str = "length") -> DataFrame:
    """Start offset of every document in the global token stream, whose order
    is (corpus_pos, copy, row_id), each compared exactly."""
    out = exclusive_prefix_sums(df, ["corpus_pos", "copy", row_id], [length])
    return out.withColumnRenamed(f"{length}_before", "start")


def pack_blocks(df: DataFrame, block_size: int, row_id: str = "row_id") -> DataFrame:
    """Concatenate all ids in global order and cut blocks
    [i*B, (i+1)*B); the last partial block is dropped.  (corpus_pos, copy,
    row_id) names a row.

    Offsets are computed on keys and lengths alone; the ids join them once.
    Returns (block_id, input_ids, first_row, first_offset, last_row,
    last_offset) -- the rows/offsets say where the block starts and ends."""
    B = int(block_size)
    keys = ["corpus_pos", "copy", row_id]
    starts = token_offsets(df.select(*keys, "length"), row_id).select(*[F.col(c).alias(f"_k_{c}") for c in keys], "start")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    offs = df.where(F.col("length") > 0).select(*keys, "input_ids", "length").join(starts, same)
    total_tokens = F.col("start") + F.col("length")
    pieces = offs.select(
        row_id, "start", "input_ids",
        F.explode(F.sequence(F.floor(F.col("start") / B), F.floor((total_tokens - 1) / B))).alias("block_id"))
    lo = F.greatest(F.col("block_id") * B, F.col("start"))
    hi = F.least((F.col("block_id") + 1) * B, F.col("start") + F.size("input_ids"))
    pieces = pieces.select(
        "block_id", row_id,
        (lo - F.col("start")).alias("off"),
        F.slice("input_ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("ids"),
        (lo - F.col("block_id") * B).alias("pos_in_block"))
    blocks = pieces.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("pos_in_block", F.col(row_id).alias("rid"), "off", "ids"))).alias("_p"))
    first = F.element_at("_p", 1)
    last = F.element_at("_p", -1)
    out = blocks.select(
        "block_id",
        F.flatten(F.transform("_p", lambda p: p["ids"])).alias("input_ids"),
        first["rid"].alias("first_row"), first["off"].alias("first_offset"),
        last["rid"].alias("last_row"), (last["off"] + F.size(last["ids"]) - 1).alias("last_offset"))
    return out.where(F.size("input_ids") == B)


def contiguous_shards(df: DataFrame, n: int, order: Sequence[str], out: str = "shard") -> DataFrame:
    """L3: ``shard(num_shards=n, contiguous=True)`` sizes (the first N mod n
    shards get one more row, as ``ntile``), from the global position."""
    pos = exclusive_prefix_sums(df.withColumn("_one", F.lit(1)), list(order), ["_one"])
    total = df.count()
    q, r = divmod(total, n)
    p = F.col("_one_before")
    big = F.lit(r * (q + 1))
    shard = (F.when(p < big, F.floor(p / F.lit(q + 1)))
             .otherwise(F.lit(r) + F.floor((p - big) / F.lit(max(q, 1)))))
    return pos.withColumn(out, (shard + 1).cast("int")).withColumnRenamed("_one_before", "position").drop("_one")


def fixed_batches(df: DataFrame, size: int, order: Sequence[str], drop_last: bool = True,
                  out: str = "batch") -> DataFrame:
    """L4: batch = floor(position / size); with ``drop_last`` rows of the
    final partial batch are removed."""
    pos = exclusive_prefix_sums(df.withColumn("_one", F.lit(1)), list(order), ["_one"])
    pos = pos.withColumn(out, F.floor(F.col("_one_before") / size).cast("long"))
    if drop_last:
        full = df.count() // size
        pos = pos.where(F.col(out) < full)
    return pos.withColumnRenamed("_one_before", "position").drop("_one")


def ordered_distinct(arr: str | Column) -> Column:
    """``dict.fromkeys`` -- duplicates removed, first occurrences kept."""
    return F.array_distinct(F.col(arr) if isinstance(arr, str) else arr)


def seeded_shuffle(df: DataFrame, seed: int, key: str, out: str = "shuffle_key") -> DataFrame:
    """L2: reproducible shuffle order md5('<seed>:<key>'), key as tie-break."""
    return df.withColumn(out, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def read_blocks_for_training(blocks: DataFrame) -> DataFrame:
    """S4 view of packed blocks: labels = ids, mask all ones."""
    return blocks.select("block_id", "input_ids",
                         F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                         F.col("input_ids").alias("labels"))


def frequency_vocab(df: DataFrame, text: str = "text", first_id: int = 3) -> DataFrame:
    """P2 vocabulary: every word/symbol token, ids from ``first_id`` by
    frequency (ties by token text).  Numbered by a range-parallel prefix sum,
    whatever the number of tokens."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD_OR_SYMBOL), 1)).alias("token"))
    counts = words.groupBy("token").agg((-F.count(F.lit(1))).alias("_n")).withColumn("_one", F.lit(1))
    ranked = exclusive_prefix_sums(counts, ["_n", "token"], ["_one"])
    return ranked.select("token", (F.col("_one_before") + first_id).cast("int").alias("id"))


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def looked_up(df: DataFrame, key: str, tokens: Column, values: DataFrame, default: Column, bag: bool = False) -> DataFrame:
    """(``key``, ``found``): for each row the array of its tokens' values by the table
    ``values(token, value)`` (``default``, which may use ``token``, where a token isn't
    listed or its value is null).  With ``bag`` each distinct token of a row comes once,
    its number of places in a third column ``n``.

    Tokens don't travel one by one: a run of rows is written once as its distinct
    tokens and small codes, packed; the distinct tokens join the table and come back to
    the codes of their run.  ``key`` may be a struct of whole rows."""
    from ..llm.frames import PACKED_BYTES, bounded_batches, kept_table, packed_rows, spare_memory, unpacked_rows
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    kind = rows.schema["key"].dataType

    def part(n: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
        found = pc.list_flatten(lists).dictionary_encode()
        codes, sizes = found.indices.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        columns = {"key": keys}
        if bag:
            most = max(len(found.dictionary), 1)
            places, counts = np.unique(np.repeat(np.arange(len(keys)), sizes) * most + codes, return_counts=True)
            codes, sizes = places % most, np.bincount(places // most, minlength=len(keys))
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        listed = lambda a: pa.ListArray.from_arrays(bounds, pa.array(a, pa.int32()))
        if bag:
            columns["counts"] = listed(counts)
        packed = packed_rows(pa.table({"codes": listed(codes), **columns}), bytewise=("codes",))
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()), pa.array([packed], pa.binary()),
                                           pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)], ["part", "rows", "tokens"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= PACKED_BYTES:
                yield part(n, held)
                n, held = n + 1, []
                spare_memory()
        if held:
            yield part(n, held)

    written = T.StructType().add("part", "long").add("rows", "binary").add("tokens", T.ArrayType(T.StringType()))
    parts = kept_table(rows.mapInArrow(coded, written), "codes", lean=True)
    named = parts.select("part", F.posexplode("tokens").alias("at", "token")).join(values.groupBy("token").agg(F.min("value").alias("value")), "token", "left")
    tables = (named.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", default).alias("value")))).alias("t"))
              .select("part", F.transform("t", lambda x: x["value"]).alias("table")))
    value = tables.schema["table"].dataType

    def given_back(packed: bytes, table: pa.Array) -> Iterator[pa.RecordBatch]:
        for run in unpacked_rows(packed).to_batches(max_chunksize=DECODED_ROWS):
            bounds, codes = pa.array(_bounds(run.column("codes")), pa.int32()), pc.list_flatten(run.column("codes"))
            out = {"key": run.column("key"), "found": pa.ListArray.from_arrays(bounds, table.take(codes))}
            if bag:
                out["n"] = pa.ListArray.from_arrays(bounds, pc.list_flatten(run.column("counts")))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, tables = batch.columns
            for i in range(batch.num_rows):
                yield from given_back(packed[i].as_py(), tables[i].values if tables[i].is_valid else tables.values.slice(0, 0))
                spare_memory()

    read = T.StructType().add("key", kind).add("found", value)
    whole = parts.select("part", "rows").join(tables, "part", "left").drop("part")
    return whole.mapInArrow(decoded, read.add("n", T.ArrayType(T.IntegerType())) if bag else read).withColumnRenamed("key", key)


def keys_repeat(df: DataFrame, key: str) -> bool:
    """Whether a key stands in several rows or is null.  Only keys travel."""
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNull() | (F.col("_n") > 1)).isEmpty()


def tokenize_with_vocab(df: DataFrame, key: str, vocab: DataFrame, text: str = "text",
                        unk_id: int = 0, eos_id: int = EOS_ID) -> DataFrame:
    """P2 with a vocabulary table: ids in token order, unknown tokens ->
    ``unk_id``, EOS appended, ``length``.  See ``looked_up`` for how the ids get to
    the texts (``key`` unique; texts of one key are merged by position)."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD_OR_SYMBOL), 1)
    found = looked_up(df, key, words, vocab.select("token", F.col("id").cast("int").alias("value")), F.lit(unk_id))
    placed = F.flatten(F.transform("_l", lambda ids: F.transform(ids, lambda x, i: F.struct(i.alias("pos"), x.alias("id")))))
    ids = found.groupBy(key).agg(F.collect_list("found").alias("_l")).select(
        key, F.when(F.size("_l") == 1, F.element_at("_l", 1)).otherwise(F.transform(F.array_sort(placed), lambda x: x["id"])).alias("_ids"))
    out = df.join(ids, key, "left").withColumn(
        "input_ids", F.concat(F.coalesce("_ids", F.array().cast("array<int>")), F.array(F.lit(eos_id))))
    return out.drop("_ids").withColumn("length", F.size("input_ids"))
