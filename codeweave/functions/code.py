"""Code text as columns: normalisation (P8, P9), structural fingerprint
(P10) for exact match (A9), candidate cleaning (P12), script splitting (S9)
and schema names from file names (S10).

Every step is a built-in Spark expression (``regexp_replace`` chains,
``regexp_extract_all`` + ``transform``), so it runs inside the JVM on each
row; the one stateful pass of the cleaning (unquoting a parameter list) is an
``aggregate`` over the token array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CODE_TOKEN, col

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists for the same normal forms)
# ---------------------------------------------------------------------------
ORACLE_SPACED_KEYWORDS = [
    "CREATE", "OR", "REPLACE", "PROCEDURE", "FUNCTION", "IS", "AS", "BEGIN", "END",
    "IF", "THEN", "ELSE", "ELSIF", "WHILE", "FOR", "LOOP", "SELECT", "FROM", "WHERE",
    "INSERT", "INTO", "UPDATE", "SET", "DELETE", "VALUES", "COUNT", "NUMBER", "VARCHAR2",
    "AND", "OR", "NOT", "NULL",
]
ORACLE_KEYWORDS = [
    "CREATE", "OR", "REPLACE", "PROCEDURE", "FUNCTION", "IS", "AS", "BEGIN", "END",
    "IF", "THEN", "ELSE", "ELSIF", "WHILE", "FOR", "LOOP", "SELECT", "FROM", "WHERE",
    "INSERT", "INTO", "UPDATE", "SET", "DELETE", "VALUES", "COUNT", "NUMBER", "VARCHAR2",
    "CHAR", "DATE", "TIMESTAMP", "DECLARE", "CURSOR", "EXCEPTION", "WHEN", "OTHERS",
    "RAISE", "RETURN", "EXIT", "CONTINUE", "CASE", "AND", "OR", "NOT", "NULL",
    "TRUE", "FALSE", "COMMIT", "ROLLBACK",
]
POSTGRES_TYPES = [
    "TEXT", "VARCHAR", "INTEGER", "INT", "BIGINT", "SMALLINT",
    "DECIMAL", "NUMERIC", "REAL", "DOUBLE PRECISION", "BOOLEAN",
    "DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ", "INTERVAL", "UUID",
]
POSTGRES_SPACED_KEYWORDS = [
    "CREATE", "OR", "REPLACE", "PROCEDURE", "FUNCTION", "LANGUAGE", "plpgsql", "AS",
    "DECLARE", "BEGIN", "END", "IF", "THEN", "ELSE", "ELSIF", "WHILE", "FOR", "LOOP",
    "SELECT", "FROM", "WHERE", "INSERT", "INTO", "UPDATE", "SET", "DELETE", "VALUES",
    "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "CURSOR", "RECORD", "OPEN", "CLOSE",
    "FETCH", "EXIT", "WHEN", "FOUND", "CURRENT", "OF", "EXCEPTION", "RAISE", "RETURN",
    "COMMIT", "ROLLBACK", "RETURNS", "RETURN",
]
POSTGRES_KEYWORDS = [
    "CREATE", "OR", "REPLACE", "PROCEDURE", "FUNCTION", "LANGUAGE", "plpgsql", "AS",
    "DECLARE", "BEGIN", "END", "IF", "THEN", "ELSE", "ELSIF", "WHILE", "FOR", "LOOP",
    "SELECT", "FROM", "WHERE", "INSERT", "INTO", "UPDATE", "SET", "DELETE", "VALUES",
    "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "CURSOR", "RECORD", "OPEN", "CLOSE",
    "FETCH", "EXIT", "WHEN", "FOUND", "CURRENT", "OF", "EXCEPTION", "RAISE", "RETURN",
    "COMMIT", "ROLLBACK", "RETURNS", "RETURN", "VOLATILE", "STABLE", "IMMUTABLE",
    "TEXT", "VARCHAR", "INTEGER", "INT", "BIGINT", "SMALLINT", "DECIMAL", "NUMERIC",
    "REAL", "DOUBLE", "PRECISION", "BOOLEAN", "DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ",
    "INTERVAL", "UUID", "JSON", "JSONB", "BYTEA", "SERIAL", "BIGSERIAL",
    "PERFORM", "GET", "DIAGNOSTICS", "ROWTYPE", "TYPE", "ARRAY", "SLICE",
    "NOTICE", "WARNING", "STRICT", "CONTINUE", "CASE", "USING", "EXECUTE",
    "FOREACH", "REVERSE", "BY", "CONCURRENTLY", "CONFLICT", "NOTHING", "EXCLUDED",
]
POSTGRES_SYSTEM_NAMES = [
    "FOUND", "RECORD", "SQLSTATE", "SQLERRM", "ROW_COUNT",
    "CURRENT_USER", "SESSION_USER", "CURRENT_TIMESTAMP", "NOW",
]
# Reserved words of the dialects, from their public documentation: like the lists
# above they are structure, not names.
ORACLE_RESERVED = [
    "ACCESS", "ADD", "ALL", "ALTER", "ANY", "ASC", "AUDIT", "BETWEEN", "BULK", "BY", "CHECK", "CLOSE", "CLUSTER",
    "COLLECT", "COLUMN", "COMPRESS", "CONNECT", "CROSS", "CURRENT", "DECIMAL", "DEFAULT", "DESC", "DISTINCT", "DROP",
    "EXCLUSIVE", "EXECUTE", "EXISTS", "FETCH", "FLOAT", "FORALL", "FULL", "GOTO", "GRANT", "GROUP", "HAVING",
    "IDENTIFIED", "IMMEDIATE", "IN", "INCREMENT", "INDEX", "INITIAL", "INNER", "INTEGER", "INTERSECT", "JOIN", "LEFT",
    "LIKE", "LIMIT", "LOCK", "LONG", "MERGE", "MINUS", "MODE", "MODIFY", "NATURAL", "NOCOPY", "NOWAIT", "OF", "ON",
    "OPEN", "OPTION", "ORDER", "OUT", "OUTER", "OVER", "PARTITION", "PRAGMA", "PRIOR", "PRIVILEGES", "PUBLIC", "RAW",
    "RENAME", "RETURNING", "REVERSE", "REVOKE", "RIGHT", "ROWNUM", "ROWS", "ROWTYPE", "SAVEPOINT", "SHARE", "SMALLINT",
    "SQL", "START", "SUBTYPE", "SYNONYM", "SYSDATE", "TABLE", "TO", "TRIGGER", "TYPE", "UNION", "UNIQUE", "USING",
    "VALIDATE", "VARCHAR", "VIEW", "WITH",
]
POSTGRES_RESERVED = [
    "ALL", "ALTER", "ANALYSE", "ANALYZE", "ANY", "ASC", "ASYMMETRIC", "BETWEEN", "BOTH", "CALL", "CAST", "CHECK",
    "COLLATE", "COLUMN", "CONSTRAINT", "CROSS", "DEFAULT", "DEFERRABLE", "DESC", "DISTINCT", "DO", "DROP", "EXCEPT",
    "EXISTS", "FOREIGN", "FREEZE", "FULL", "GRANT", "GROUP", "HAVING", "ILIKE", "IN", "INITIALLY", "INNER", "INOUT",
    "INTERSECT", "IS", "ISNULL", "JOIN", "LATERAL", "LEADING", "LEFT", "LIKE", "LIMIT", "MERGE", "MOVE", "NATURAL",
    "NOTNULL", "OFFSET", "ON", "ONLY", "ORDER", "OUT", "OUTER", "OVER", "OVERLAPS", "PARTITION", "PLACING", "PRIMARY",
    "REFERENCES", "RETURNING", "REVOKE", "RIGHT", "SIMILAR", "SOME", "SYMMETRIC", "TABLE", "TO", "TRAILING", "TRUNCATE",
    "UNION", "UNIQUE", "VARIADIC", "VIEW", "WINDOW", "WITH",
]
ORACLE_TERMINATOR = "END;"
POSTGRES_TERMINATOR = "$$;"

# Sentinel for $$ bodies while PostgreSQL text is normalised (no < or >, so
# the operator rules cannot touch it and bodies with '<' are restored too).
_BODY_OPEN, _BODY_CLOSE = "@@BODY@@", "@@ENDBODY@@"


# ---------------------------------------------------------------------------
# Rewrite rules: fixed values (the normal form must equal the reference's).
# Each is (pattern, replacement, ignore_case); replacements use $n.  Words are
# Unicode words: Spark gets (?U) where a pattern has word classes.
# ---------------------------------------------------------------------------

def _kw_rule(kw: str, repl: str | None = None) -> tuple[str, str, bool]:
    return (r"\b" + kw + r"\b", repl if repl is not None else f" {kw} ", True)


_PARAM_MODE = (r"\(\s*(\w+)\s+(IN|OUT|INOUT)\s+(\w+)\s*\)", "($1 $3)", True)
_CALL_STAR = (r"(\w+)\s*\(\s*\*\s*\)", "$1(*)", True)
_CALL_ARGS = (r"(\w+)\s*\(\s*([^)]+)\s*\)", "$1($2)", False)
# Spark-side forms of the two call rules: (?<!\w) only skips match attempts
# inside a word (the leftmost match of (\w+) always starts at a word start),
# so the text is the same with far less backtracking
_FASTER = {_CALL_STAR[0]: r"(?<!\w)" + _CALL_STAR[0], _CALL_ARGS[0]: r"(?<!\w)" + _CALL_ARGS[0]}
_SQUEEZE = [(r"\s*\(\s*", "(", False), (r"\s*\)\s*", ")", False),
            (r"\s*;\s*", ";", False), (r"\s*,\s*", ",", False)]


def oracle_rules(with_keywords: bool = True) -> list[tuple[str, str, bool]]:
    rules = [_PARAM_MODE, _CALL_STAR, _CALL_ARGS] + _SQUEEZE + [(r"\s*=\s*", "=", False)]
    return rules + ([_kw_rule(k) for k in ORACLE_SPACED_KEYWORDS] if with_keywords else [])


def postgres_rules(with_keywords: bool = True) -> list[tuple[str, str, bool]]:
    rules = ([(r"\$\$([^$]*)\$\$", _BODY_OPEN + "$1" + _BODY_CLOSE, False),
              (r"\s+LANGUAGE\s+plpgsql\s+", " LANGUAGE plpgsql ", True),
              _PARAM_MODE]
             + [_kw_rule(t.lower(), t) for t in POSTGRES_TYPES]
             + [(r"(\w+)\s+(%TYPE|%ROWTYPE)", "$1$2", True),
                (r"\s+EXCEPTION\s+WHEN\s+", " EXCEPTION WHEN ", True),
                (r"\s+WHEN\s+OTHERS\s+", " WHEN OTHERS ", True),
                (r"\s+CURRENT\s+OF\s+", " CURRENT OF ", True),
                (r"\s+EXIT\s+WHEN\s+", " EXIT WHEN ", True),
                (r"\s+NOT\s+FOUND\s*", " NOT FOUND ", True),
                _CALL_STAR, _CALL_ARGS] + _SQUEEZE
             + [(r"\s*=\s*", "=", False), (r"\s*>\s*", ">", False), (r"\s*<\s*", "<", False),
                (r"\s*:=\s*", ":=", False), (r'\s*"\s*([^"]+)\s*"\s*', '"$1"', False)])
    return rules + ([_kw_rule(k) for k in POSTGRES_SPACED_KEYWORDS] if with_keywords else [])


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _spell_words(c: Column, spelling: dict[str, str]) -> Column:
    """ASCII text with every whole word whose upper case is listed written as given there:
    one look-up for each word instead of one pattern for each listed word."""
    out = lambda w: F.element_at(F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv]), F.upper(w))
    return F.array_join(F.transform(F.split(c, r"\b"), lambda w: F.when(F.upper(w).isin(*spelling), out(w)).otherwise(w)), "")


def _space_keywords(c: Column, keywords: list[str], ascii: bool) -> Column:
    """Blank around every whole-word keyword, keyword in its listed spelling.

    ASCII text: see ``_spell_words``.  Otherwise one alternation pass inserts the blanks (case kept); after it every
    keyword is a blank-delimited token, so one split/transform/join sets the
    spelling.  Same text as one replacement per keyword, in far fewer passes."""
    kws = list(dict.fromkeys(keywords))
    if ascii:
        return _spell_words(c, {k.upper(): f" {k} " for k in kws})
    c = F.regexp_replace(c, r"(?iU)\b(" + "|".join(kws) + r")\b", " $1 ")
    spelled = {k.upper(): k for k in kws}

    def spell(t: Column) -> Column:
        up = F.upper(t)
        out = up
        for u, k in spelled.items():
            if k != u:
                out = F.when(up == u, F.lit(k)).otherwise(out)
        return F.when(up.isin(*spelled), out).otherwise(t)  # isin on many literals = hash set
    return F.array_join(F.transform(F.split(c, " "), spell), " ")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _collapse(c: Column, ascii: bool = False) -> Column:
    if ascii:  # the same, without a replacement for each single blank
        return F.regexp_replace(F.trim(c, F.lit(" \t\n\x0b\f\r")), r"[\t\n\x0B\f\r]\s*| \s+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")


def normalize_code(code: str | Column, dialect: str = "oracle") -> Column:
    """Whitespace, parameter modes, call and punctuation spacing,
    type names (PostgreSQL), then one blank around every listed keyword
    (upper-cased), blanks collapsed.  Keywords inside quotes are rewritten
    too, as in the reference.  ASCII text goes by the same rules without Unicode
    classes, which gives the same at a fraction of the cost."""
    return _bound(col(code), lambda c: F.when(_is_ascii(c), _normalized(c, dialect, True)).otherwise(_normalized(c, dialect, False)))


# What an ASCII text must hold, in upper case, for a rule to match.
_NEEDS = {_CALL_STAR[0]: "*", r"(\w+)\s+(%TYPE|%ROWTYPE)": "%", r"\s+EXCEPTION\s+WHEN\s+": "EXCEPTION", r"\s+WHEN\s+OTHERS\s+": "OTHERS",
          r"\s+CURRENT\s+OF\s+": "CURRENT", r"\s+EXIT\s+WHEN\s+": "EXIT", r"\s+NOT\s+FOUND\s*": "FOUND", r"\s*:=\s*": ":=",
          r'\s*"\s*([^"]+)\s*"\s*': '"', r"\bdouble precision\b": "DOUBLE"}


def _where(needed: str, c: Column, pattern: str, repl: str) -> Column:
    return _bound(c, lambda x: F.when(F.upper(x).contains(needed), F.regexp_replace(x, pattern, repl)).otherwise(x))


def _normalized(c: Column, dialect: str, ascii: bool) -> Column:
    c = _collapse(c, ascii)
    oracle = dialect == "oracle"
    rules = oracle_rules(False) if oracle else postgres_rules(False)
    # the blank squeezes around single characters only delete blanks next to
    # their own character, so their order does not matter: one pass does all
    squeeze = {r[0]: r[1] for r in _SQUEEZE + [(r"\s*=\s*", "="), (r"\s*>\s*", ">"), (r"\s*<\s*", "<")]}
    chars = "".join(squeeze[pat] for pat, _, _ in rules if pat in squeeze)
    words = {t: t for t in POSTGRES_TYPES if " " not in t} if ascii and not oracle else {}
    own = {_kw_rule(t.lower(), t)[0] for t in words}
    done = False
    for pat, repl, icase in rules:
        if pat in own:
            if words:
                c, words = _spell_words(c, words), {}
            continue
        if pat in squeeze:
            if not done:
                c = F.regexp_replace(c, r"\s*([" + "".join("\\" + ch for ch in chars) + r"])\s*", "$1")
                done = True
            continue
        flags = ("i" if icase else "") + ("U" if (r"\w" in pat or r"\b" in pat) and not ascii else "")
        full = (f"(?{flags})" if flags else "") + _FASTER.get(pat, pat)
        if ascii and pat in _NEEDS:
            c = _where(_NEEDS[pat], c, full, repl)
        else:
            c = F.regexp_replace(c, full, repl)
    c = _space_keywords(c, ORACLE_SPACED_KEYWORDS if oracle else POSTGRES_SPACED_KEYWORDS, ascii)
    c = _collapse(c, ascii)
    if dialect != "oracle":
        c = F.regexp_replace(c, _BODY_OPEN + "(.*?)" + _BODY_CLOSE, r"\$\$$1\$\$")
    return c


# ---------------------------------------------------------------------------
# Structural fingerprint (P10) and exact match
# ---------------------------------------------------------------------------

# string literal ('' inside stands for a quote) | range dots | number (1, 1.5, .5, 1e5) | dotted name |
# quoted name | two-char operator | any other symbol
FINGERPRINT_TOKEN = (r"('[^']*(?:''[^']*)*'|\.\.|(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?|[\p{L}_][\p{L}\p{N}_$#]*(?:\.[\p{L}_][\p{L}\p{N}_$#]*)*"
                     r"|\"[^\"]*\"|:=|<=|>=|<>|!=|\|\||[^\s\p{L}\p{N}_])")


def fingerprint_tokens(normalized: str | Column, dialect: str = "oracle") -> Column:
    """Token classes of normalised code: literals become <STRING>/<NUMBER>,
    names that are neither keywords nor reserved words (including table and
    column names, and everything quoted) become <IDENTIFIER>, keywords are
    upper-cased, symbols stay."""
    kws = (ORACLE_KEYWORDS + ORACLE_RESERVED if dialect == "oracle"
           else POSTGRES_KEYWORDS + POSTGRES_SYSTEM_NAMES + POSTGRES_RESERVED)
    # an upper-cased token can only equal the upper-case entries (the
    # lower-case 'plpgsql' entry never matches, as in the reference)
    upper_kws = [k for k in dict.fromkeys(kws) if k == k.upper()]
    plain = FINGERPRINT_TOKEN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    toks = _bound(col(normalized), lambda c: F.when(_is_ascii(c), F.regexp_extract_all(c, F.lit(plain), 1))
                  .otherwise(F.regexp_extract_all(c, F.lit(FINGERPRINT_TOKEN), 1)))

    def cls(t: Column) -> Column:
        return (F.when(t.startswith("'"), F.lit("<STRING>"))
                .when(F.upper(t).isin(*upper_kws), F.upper(t))
                .when(t.rlike(r"^\.?[0-9]"), F.lit("<NUMBER>"))
                .when(t.rlike(r'^[\p{L}_"]'), F.lit("<IDENTIFIER>"))
                .otherwise(t))
    return F.transform(toks, cls)


def code_fingerprint(code: str | Column, dialect: str = "oracle") -> Column:
    """sha-256 of the token classes of the normalised code: equal
    fingerprints = same shape (the EM notion of the reference)."""
    toks = fingerprint_tokens(normalize_code(code, dialect), dialect)
    return F.sha2(F.array_join(toks, " "), 256)


def exact_match(gold: str | Column, pred: str | Column, dialect: str = "oracle") -> Column:
    """1 when both codes have the same fingerprint; NULL input -> 0."""
    return F.coalesce((code_fingerprint(gold, dialect) == code_fingerprint(pred, dialect)).cast("int"), F.lit(0))


# ---------------------------------------------------------------------------
# Candidate cleaning
# ---------------------------------------------------------------------------

_MARK = "\u0001"  # between tokens; a control character that no code contains


def _cut_after(code: Column, terminator: str) -> Column:
    idx = F.instr(code, terminator)
    return F.when(idx > 0, F.substring(code, F.lit(1), idx + len(terminator) - 1)).otherwise(code)


def clean_candidate(code: str | Column, terms: str | Column, dialect: str = "oracle") -> Column:
    """Cut after the first terminator, tokenise, quote tokens found in
    the schema terms, call the procedure ``sp``, unquote its parameter list,
    (PostgreSQL) join ``$ $``, glue split operators, join by one blank and
    repair quotes and decimals.

    Lambdas only read fields of their own element: neighbours come from
    ``arrays_zip`` with shifted slices, so every array is computed once per
    row (an array expression looked up inside a lambda would be recomputed
    for every element)."""
    term_arr = col(terms)
    cut = _cut_after(col(code), ORACLE_TERMINATOR if dialect == "oracle" else POSTGRES_TERMINATOR)
    return _bound(F.regexp_extract_all(cut, F.lit(CODE_TOKEN), 1), lambda toks: _cleaned(toks, term_arr, dialect))


def _cleaned(toks: Column, term_arr: Column, dialect: str) -> Column:
    """``clean_candidate`` from the tokens on."""
    n = F.size(toks)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(toks, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(toks, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    zipped = F.arrays_zip(toks.alias("t"), prev.alias("p"), nxt.alias("q"))

    def quote(t: Column) -> Column:
        return F.when(F.array_contains(term_arr, t), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)

    def rename(e, i):
        hit = ((i >= 1) & e["q"].isNotNull() & F.lower(quote(e["p"])).isin("procedure", "function")
               & (quote(e["q"]) == "("))
        return F.when(hit, F.lit("sp")).otherwise(quote(e["t"]))
    named = F.transform(zipped, rename)

    # between a "(" behind "sp" (or the other way round) and the next ")" double quotes go:
    # in each stretch up to a ")", from where the later of the two first stands
    mark = lambda t: _MARK + t + _MARK  # noqa: E731 - every token stands between marks
    whole = F.concat(F.lit(_MARK), F.array_join(named, _MARK + _MARK), F.lit(_MARK))

    def strip(stretch):
        called, opened = F.instr(stretch, mark("sp")), F.instr(stretch, mark("("))
        since = F.greatest(called, opened)
        rest = F.replace(F.substr(stretch, since), F.lit('"'), F.lit(""))
        return F.when((called > 0) & (opened > 0), F.concat(F.substr(stretch, F.lit(1), since - 1), rest)).otherwise(stretch)
    stripped = F.array_join(F.transform(F.split(whole, mark(r"\)")), strip), mark(")"))
    inner = _bound(stripped, lambda s: F.substr(s, F.lit(2), F.char_length(s) - 2))
    unquoted = F.when(n > 0, F.split(inner, _MARK + _MARK)).otherwise(F.array().cast("array<string>"))
    return _bound(unquoted, lambda tokens: _glued(tokens, dialect))


def _glued(unquoted: Column, dialect: str) -> Column:
    """The text of the cleaned tokens."""
    if dialect != "oracle":
        m = F.size(unquoted)
        after = F.concat(F.slice(unquoted, 2, F.greatest(m - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
        pairs = F.arrays_zip(unquoted.alias("t"), after.alias("q"))
        dollars = F.transform(pairs, lambda e: F.when((e["t"] == "$") & (e["q"] == "$"), F.lit("$$"))
                              .otherwise(e["t"]))
        unquoted = F.filter(dollars, lambda t: t != "$")

    text = F.array_join(unquoted, " ")
    # left-to-right, non-overlapping operator gluing; a glued pair leaves the
    # blank of the emptied token, the very last pair of tokens is never glued
    text = F.regexp_replace(text, r"(?<![^ ])(?:([=<>!:]) (=)|(<) (>)|(\|) (\|))(?= [^ ])", "$1$2$3$4$5$6 ")
    text = F.regexp_replace(text, r"(?<![^ ])' % '(?![^ ])", "'%'  ")
    text = F.regexp_replace(text, r'" +"', '"')
    text = F.regexp_replace(text, r"(\d+)\s*\.\s*(\d+)", "$1.$2")
    text = F.regexp_replace(text, r'"\s*(.*?)\s*"', '"$1"')
    return text


# ---------------------------------------------------------------------------
# Scripts (S9, S10)
# ---------------------------------------------------------------------------

def split_statements(content: str | Column) -> Column:
    """S9 helper: statements of a script split on ';', stripped, without
    empty ones and those starting with '--' (a statement preceded by a
    comment line is dropped with it, as in the reference).  Returns
    array<struct<pos:int, stmt:string>> (pos is 1-based over kept ones)."""
    parts = F.transform(F.split(col(content), ";"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(parts, lambda s: (s != "") & ~s.startswith("--"))
    return F.transform(kept, lambda s, i: F.struct((i + 1).alias("stmt_pos"), s.alias("stmt")))


def schema_name_from_path(path: str | Column) -> Column:
    """Base name without ``.sqlite.sql`` or ``.sql``, characters other
    than [A-Za-z0-9_] replaced by '_', cut to 30, lower-cased."""
    base = F.regexp_extract(col(path), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(\.sqlite\.sql|\.sql)$", "")
    return F.lower(F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9_]", "_"), 1, 30))


def code_skeleton(code: str | Column, dialect: str = "oracle") -> Column:
    """Skeleton of a procedure: the normalised token classes with every
    name and literal written as ``_`` (the template form the skeleton trees
    and the skeleton column of a task use)."""
    toks = fingerprint_tokens(normalize_code(code, dialect), dialect)
    masked = F.transform(toks, lambda t: F.when(t.isin("<IDENTIFIER>", "<NUMBER>", "<STRING>"), F.lit("_"))
                         .otherwise(t))
    return F.regexp_replace(F.array_join(masked, " "), r"_( _)+", "_")
