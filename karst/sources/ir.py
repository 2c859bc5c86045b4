"""Typed program trees (JSON) and s-expression texts as relations.

Spark has no recursive types, so a tree becomes rows of a nested set: every node has the interval (pre, post) that holds those of
all its descendants, and a subtree is a range predicate. Files are read with Spark; each is parsed where it is read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "file string, script int, owner string, body string, node int, parent int, ord int, depth int, post int, t string, name string, vtype string, idx int, value int"
OBJECT = "file string, script int, name string, is_class boolean, species int, super int"
PROPERTY = "file string, script int, object string, name string, sel int, value int"
EXPORT = "file string, script int, idx int, name string"
LOCAL = "file string, script int, idx int, value int"


def _integer(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def flattened(tree: dict) -> list[tuple]:
    """node, parent, ord, depth, post, t, name, vtype, idx, value of each node, in the order of a walk; null children are left out."""
    rows: list[list] = []
    todo: list[tuple] = [(tree, None, 0, 0)]
    while todo:
        node, parent, place, depth = todo.pop()
        if node is None:  # an end: everything since is below
            rows[parent][4] = len(rows) - 1
            continue
        at = len(rows)
        rows.append([at, parent, place, depth, at, node.get("t"), node.get("name"), node.get("vtype"), _integer(node.get("index")), _integer(node.get("value"))])
        todo.append((None, at, 0, 0))
        todo += [(kid, at, k, depth + 1) for k, kid in reversed(list(enumerate(node.get("kids") or []))) if kid]
    return [tuple(r) for r in rows]


def _rows(kind: str, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches):
        for b in batches:
            out: list[tuple] = []
            for file, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                for s in json.loads(text).get("scripts", []):
                    base = (file, s["number"])
                    if kind == "object":
                        out += [(*base, o["name"], bool(o["isClass"]), _integer(o.get("species")), _integer(o.get("super"))) for o in s.get("objects", [])]
                    elif kind == "property":
                        out += [(*base, o["name"], p["name"], _integer(p.get("sel")), _integer(p.get("value"))) for o in s.get("objects", []) for p in o.get("properties", [])]
                    elif kind == "export":
                        out += [(*base, k, name) for k, name in enumerate(s.get("exports") or [])]
                    elif kind == "local":
                        out += [(*base, x["index"], _integer(x.get("value"))) for x in s.get("locals", [])]
                    else:
                        bodies = [(o["name"], m["name"], m["ast"]) for o in s.get("objects", []) for m in o.get("methods", [])]
                        bodies += [("", p["name"], p["ast"]) for p in s.get("procedures", [])]
                        out += [(*base, owner, body, *row) for owner, body, tree in bodies if tree for row in flattened(tree)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[d.split()[1]]) for c, d in zip(columns, schema.split(", "), strict=True)], names=names)

    return parse


def read_ir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """node, object, property, export and local of every program below a path. Values that are no integers are null."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return {kind: texts.mapInArrow(_rows(kind, schema), schema) for kind, schema in (("node", NODE), ("object", OBJECT), ("property", PROPERTY), ("export", EXPORT), ("local", LOCAL))}


_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<open>[(\[])|(?P<close>[)\]])|(?P<string>"(?:\\.|[^"\\])*"|\{[^}]*\}|'[^']*')|(?P<int>-?(?:\d+|\$[0-9a-fA-F]+)(?=[\s()\[\];]|$))|(?P<symbol>[^\s()\[\];"{}']+)""")


def forms(text: str) -> list[tuple]:
    """form, parent, ord, kind, token, first, last of each form of a text; brackets must close."""
    rows: list[list] = []
    stack: list[int] = []
    counts = {None: 0}
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "close":
            if not stack:
                raise ValueError(f"a bracket closes at {m.start()} that never opened")
            rows[stack.pop()][6] = m.end()
            continue
        parent = stack[-1] if stack else None
        rows.append([len(rows), parent, counts[parent], "list" if kind == "open" else kind, m.group() if kind != "open" else None, m.start(), m.end()])
        counts[parent] += 1
        if kind == "open":
            stack.append(len(rows) - 1)
            counts[len(rows) - 1] = 0
    if stack:
        raise ValueError(f"the bracket at {rows[stack[-1]][5]} never closes")
    return [tuple(r) for r in rows]


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """The forms of every source text below a path."""

    def parse(batches):
        for b in batches:
            out = [(file, *r) for file, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True) for r in forms(text)]
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            names = ["file", "form", "parent", "ord", "kind", "token", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return texts.mapInArrow(parse, "file string, form int, parent int, ord int, kind string, token string, first int, last int")
