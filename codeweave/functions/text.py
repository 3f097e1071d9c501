"""Column functions over text (P1, P6, P11, P17 helpers, token patterns).
All are built-in Spark expressions, so they stay inside whole-stage codegen
(except the higher-order ones, which run interpreted but on the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word / single-symbol tokens, Unicode letters and digits spelled out so that
# Java and RE2 (DuckDB) agree: Java's \w is ASCII-only without (?U).
WORD_OR_SYMBOL = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
# The cleaning step's tokens follow the same rule: names may hold any letters.
CODE_TOKEN = WORD_OR_SYMBOL

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's texts for identical prompts)
# ---------------------------------------------------------------------------
COT_ORACLE = (
    "To generate the PL/SQL code for the procedure: Start with the procedure header using CREATE OR REPLACE "
    "PROCEDURE sp(); Specify the required parameters with correct Oracle types like VARCHAR2 or NUMBER. After the "
    "header, declare the procedure body with IS, and add any needed variable or cursor declarations. Declare local "
    "variables used within the procedure body, including appropriate types and optional default values. Begin the "
    "logic with a BEGIN block. Consider what control structures are needed—do you need a LOOP, IF statement, or a "
    "cursor with FETCH and WHERE CURRENT OF? Use proper OPEN, FETCH, and CLOSE for cursors, and IF...THEN for "
    "conditional logic. Finish with END;, ensuring the logic handles relevant conditions and updates data as expected."
)
COT_POSTGRES = (
    "To generate the PLpgSQL code for the procedure: Start with the procedure header using CREATE OR REPLACE "
    "PROCEDURE sp(); Specify the required parameters with correct PostgreSQL types like TEXT, INTEGER, or NUMERIC. "
    "After the header, declare the language using LANGUAGE plpgsql;. Then, declare the procedure body using a "
    "DECLARE block if needed, and add any variable or cursor declarations. Declare local variables used within the "
    "procedure body, including appropriate types and optional default values. Begin the logic with a BEGIN block. "
    "Consider what control structures are needed—do you need a LOOP, IF statement, or a cursor with FETCH and WHERE "
    "CURRENT OF? Use proper OPEN, FETCH, and CLOSE for cursors, and IF...THEN for conditional logic. Finish with "
    "END;, ensuring the logic handles relevant conditions and updates data as expected."
)
INSTRUCTION_LINE = "Output the PL/SQL procedure. Begin with CREATE OR REPLACE PROCEDURE sp();"
SKELETON_LABEL = "Skeleton: "


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind
    (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def cot_hint(text: str | Column) -> Column:
    """The Oracle hint when the lower-cased text mentions 'oracle', else
    the PostgreSQL hint."""
    return F.when(F.lower(col(text)).contains("oracle"), F.lit(COT_ORACLE)).otherwise(F.lit(COT_POSTGRES))


def word_tokens(text: str | Column) -> Column:
    """Words and single symbols (Unicode-aware, same result in DuckDB)."""
    return F.regexp_extract_all(col(text), F.lit(WORD_OR_SYMBOL), 1)


def schema_terms(schema_items: str | Column) -> Column:
    """Table names followed by their column names, for every table."""
    return F.flatten(F.transform(col(schema_items),
                                 lambda t: F.concat(F.array(t["table_name"]), t["column_names"])))


def corpus_text(first: str | Column, second: str | Column | None = None) -> Column:
    """Strip one field, or join two with a newline and strip."""
    if second is None:
        return strip(first)
    return strip(F.concat(col(first), F.lit("\n"), col(second)))
