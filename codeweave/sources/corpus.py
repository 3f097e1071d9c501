"""JSON-lines corpora of four kinds, read with a declared schema and
unified to (corpus, row_id, text) with the P1 text rule applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import corpus_text

# The four corpus kinds and their fields.
CORPUS_FIELDS = {
    "plsql": ("plsql",),
    "sql": ("sql",),
    "text2text": ("input_text", "output_text"),
    "text2code": ("text", "code"),
}


def read_corpus(spark: SparkSession, path: str, kind: str, id_col: str | None = None) -> DataFrame:
    """Read one corpus.  ``row_id`` is the explicit id column when given,
    else ``monotonically_increasing_id`` (file order within a fixed split
    layout)."""
    fields = CORPUS_FIELDS[kind]
    ddl = ", ".join(f"`{f}` string" for f in fields)
    if id_col:
        ddl = f"`{id_col}` long, " + ddl
    df = spark.read.schema(ddl).json(path)
    rid = F.col(id_col) if id_col else F.monotonically_increasing_id()
    text = corpus_text(fields[0]) if len(fields) == 1 else corpus_text(fields[0], fields[1])
    return df.select(F.lit(kind).alias("corpus"), rid.alias("row_id"), text.alias("text"))
