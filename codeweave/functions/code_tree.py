"""Nested comparison of procedures (P10 / A9): a Merkle tree of statements, blocks and
brackets over the token classes of ``fingerprint_tokens``."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .code import fingerprint_tokens, normalize_code
from .text import col

# What opens and closes a block; END may be followed by one of the openers.
OPENERS = ["BEGIN", "IF", "LOOP", "CASE", "("]
END_OF = ["IF", "LOOP", "CASE"]

NODE = StructType([StructField(name, StringType()) for name in ("path", "kind", "fingerprint")])


class Node:
    """A statement (``kind`` STATEMENT), a block or bracket (its opener), or one token
    (``kind`` TOKEN, ``value`` its class).  ``mark`` is made from the children's marks."""

    __slots__ = ("kind", "value", "children", "mark")

    def __init__(self, kind: str, value: str = ""):
        self.kind, self.value, self.children, self.mark = kind, value, [], b""

    def close(self) -> "Node":
        digest = hashlib.sha256(f"{self.kind} {self.value}".encode())
        for child in self.children:
            digest.update(child.mark)
        self.mark = digest.digest()
        return self


@lru_cache(4096)
def _token(value: str) -> Node:
    """The closed node of one token; trees share it."""
    return Node("TOKEN", value).close()


def _ends_with_statement(block: Node) -> None:
    """An open statement of a block is over."""
    if block.children and not block.children[-1].mark:
        block.children[-1].close()


def _statement(block: Node) -> Node:
    """The block's open statement; a new one after a closed one."""
    if not block.children or block.children[-1].mark:
        block.children.append(Node("STATEMENT"))
    return block.children[-1]


def parse(tokens) -> Node:
    """The tree of a token sequence, in one pass: openers go down, END and ) go up (never
    above the root), a semicolon ends a statement of its block.  What is never closed is
    closed at the end."""
    root = Node("CODE")
    path = [root]
    tokens, i = list(tokens), 0
    while i < len(tokens):
        token = tokens[i]
        if token == ";":
            _statement(path[-1]).close()
        elif token in OPENERS:
            block = Node(token)
            _statement(path[-1]).children.append(block)
            path.append(block)
        elif token in ("END", ")"):
            if token == "END" and i + 1 < len(tokens) and tokens[i + 1] in END_OF:
                i += 1
            if len(path) > 1:
                _ends_with_statement(path[-1])
                path.pop().close()
        else:
            _statement(path[-1]).children.append(_token(token))
        i += 1
    while path:
        _ends_with_statement(path[-1])
        path.pop().close()
    return root


def first_path(a: Node, b: Node) -> list[str] | None:
    """The way to the first difference, down from the roots, or None: only nodes with
    different marks are entered."""
    if a.mark == b.mark:
        return None
    steps = []
    while True:
        if a.kind != b.kind or a.value != b.value:
            return steps
        at = next((i for i, (x, y) in enumerate(zip(a.children, b.children)) if x.mark != y.mark), None)
        if at is None:  # one has more children
            return [*steps, _step(max(a.children, b.children, key=len), min(len(a.children), len(b.children)))]
        steps.append(_step(a.children, at))
        a, b = a.children[at], b.children[at]


def _step(children: list[Node], at: int) -> str:
    return f"{at + 1}:{children[at].kind if children[at].kind != 'TOKEN' else children[at].value}"


@pandas_udf(StructType([StructField("same", IntegerType()), StructField("path", StringType())]))
def _compared(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Token classes of both sides, joined by blanks (no class has one; null: no code).
    Trees are built for the pairs that differ only."""
    def one(a, b):
        if a is None or b is None:
            return 0, None if a is b else ""
        if a == b:
            return 1, None
        found = first_path(parse(a.split()), parse(b.split()))
        return 0, None if found is None else "/".join(found)

    rows = [one(a, b) for a, b in zip(gold, pred)]
    return pd.DataFrame({"same": pd.Series([s for s, _ in rows], dtype="int32"), "path": pd.Series([p for _, p in rows], dtype=object)})


def _nodes(node: Node):
    todo = [("", node)]
    while todo:
        path, node = todo.pop()
        if node.kind != "TOKEN":
            yield {"path": path, "kind": node.kind, "fingerprint": node.mark.hex()}
            todo += [(f"{path}/{_step(node.children, i)}".lstrip("/"), node.children[i]) for i in range(len(node.children) - 1, -1, -1)]


@pandas_udf(ArrayType(NODE))
def _tree(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else list(_nodes(parse(t))) for t in tokens], dtype=object)


def _tokens(code: str | Column, dialect: str) -> Column:
    return fingerprint_tokens(normalize_code(col(code), dialect), dialect)


def code_tree(code: str | Column, dialect: str = "oracle") -> Column:
    """Statements, blocks and brackets of a procedure in preorder, as array of (path, kind,
    fingerprint); equal fingerprints = equal subtrees.  A path names each step's place
    and kind (``2:STATEMENT/1:BEGIN``); the root's is empty.  Null code gives null."""
    return _tree(_tokens(code, dialect))


def first_difference(gold: str | Column, pred: str | Column, dialect: str = "oracle") -> Column:
    """The path of the first node in which two procedures differ, null where they match
    (``exact_match``), the empty path where only one is null or the whole is of another
    kind.  The last step names the gold node, or the one that the other side lacks."""
    return _comparison(gold, pred, dialect)["path"]


def _comparison(gold: str | Column, pred: str | Column, dialect: str) -> Column:
    flat = [F.array_join(_tokens(c, dialect), " ") for c in (gold, pred)]
    return _compared(*flat)


def compare_code(df, gold: str, pred: str, dialect: str = "oracle"):
    """``df`` with ``same`` (1 / 0; null code: 0) and ``first_difference``.  Either code is
    normalised once, and trees are built for the pairs that differ only."""
    found = df.withColumn("_compared", _comparison(gold, pred, dialect))
    return found.withColumn("same", F.col("_compared.same")).withColumn("first_difference", F.col("_compared.path")).drop("_compared")
