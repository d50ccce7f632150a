"""A Gremlin subset compiled to joins.

``g.V()`` then any of ``hasLabel(..) has(k, v) has(k) hasNot(k) out(..) in(..) both(..) repeat(out(..)).times(n) dedup() limit(n) range(a, b)
order().by(k[, desc]) values(k) count() groupCount().by(k) id() label() valueMap()``. One row is one traverser; ``has`` also takes
``within(..)``, ``startingWith(..)``, ``gt lt gte lte neq``. Anything else raises :class:`Unsupported`.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.query.cypher import Unsupported

_RESERVED = re.compile(r"\b(in|as|from|is|not|and|or)(?=\s*\()")


def _steps(text: str) -> list[tuple[str, list]]:
    """The chain as (name, arguments), read by Python's own expression parser."""
    try:
        node = ast.parse(_RESERVED.sub(r"\1_", text.strip().rstrip(";")), mode="eval").body
    except SyntaxError as e:
        raise Unsupported(f"cannot read the traversal: {e}") from e
    out = []
    while isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        out.append((node.func.attr.rstrip("_"), node.args))
        node = node.func.value
    if not (isinstance(node, ast.Name) and node.id == "g"):
        raise Unsupported("a traversal begins with g.V()")
    return out[::-1]


def _value(node: ast.AST, params: dict):
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        if node.id in params:
            return params[node.id]
        if node.id in ("asc", "desc"):
            return node.id
    raise Unsupported(f"cannot read the value {ast.unparse(node)}")


def _test(c: Column, node: ast.AST, params: dict) -> Column:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        f, args = node.func.id, [_value(a, params) for a in node.args]
        if f == "within":
            return c.isin([str(a) for a in args])
        if f == "startingWith":
            return F.startswith(c, F.lit(args[0]))
        if f in ("gt", "lt", "gte", "lte"):
            n = c.try_cast("double")
            return {"gt": n > args[0], "lt": n < args[0], "gte": n >= args[0], "lte": n <= args[0]}[f]
        if f == "neq":
            return c != str(args[0])
        raise Unsupported(f"no predicate {f}")
    v = _value(node, params)
    return c == (str(v).lower() if isinstance(v, bool) else str(v))


def query(vertices: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> DataFrame:
    params = params or {}
    steps = _steps(text)
    if not steps or steps[0][0] != "V":
        raise Unsupported("a traversal begins with g.V()")
    ids = [_value(a, params) for a in steps[0][1]]
    df = vertices.filter(F.col("v").isin(ids)) if ids else vertices
    done = False

    def move(rows: DataFrame, way: str, types: list[str]) -> DataFrame:
        e = edges.filter(F.col("etype").isin(types)) if types else edges
        out = e.select(F.col("src").alias("v"), F.col("dst").alias("to"))
        back = e.select(F.col("dst").alias("v"), F.col("src").alias("to"))
        one = {"out": out, "in": back, "both": out.unionByName(back)}[way]
        return rows.select("v").join(one, "v").select(F.col("to").alias("v")).join(vertices, "v")

    i = 1
    while i < len(steps):
        name, args = steps[i]
        i += 1
        if done and name not in ("dedup", "limit", "range", "count", "order"):
            raise Unsupported(f"{name} after values")
        if name == "hasLabel":
            df = df.filter(F.col("label").isin([_value(a, params) for a in args]))
        elif name == "has" and args:
            c = F.col("props")[_value(args[0], params)]
            df = df.filter(c.isNotNull() if len(args) == 1 else _test(c, args[1], params))
        elif name == "hasNot":
            df = df.filter(F.col("props")[_value(args[0], params)].isNull())
        elif name in ("out", "in", "both"):
            df = move(df, name, [_value(a, params) for a in args])
        elif name == "repeat":
            inner = args[0] if args else None
            if not (isinstance(inner, ast.Call) and isinstance(inner.func, ast.Name) and inner.func.id.rstrip("_") in ("out", "in", "both")):
                raise Unsupported("repeat takes out, in or both")
            if i >= len(steps) or steps[i][0] != "times":
                raise Unsupported("repeat needs times")
            for _ in range(_value(steps[i][1][0], params)):
                df = move(df, inner.func.id.rstrip("_"), [_value(a, params) for a in inner.args])
            i += 1
        elif name == "dedup":
            df = df.distinct() if done else df.dropDuplicates(["v"])
        elif name == "limit":
            df = df.limit(_value(args[0], params))
        elif name == "range":
            a, b = (_value(x, params) for x in args)
            df = df.offset(a).limit(b - a)
        elif name == "order":
            key, down = ("value" if done else None), False
            if i < len(steps) and steps[i][0] == "by":
                by = [_value(a, params) for a in steps[i][1]]
                key, down = (by[0] if by and by[0] not in ("asc", "desc") else key), "desc" in by
                i += 1
            c = F.col("value") if done else F.col("props")[key] if key else F.col("v")
            df = df.orderBy(c.desc() if down else c.asc())
        elif name == "values":
            key = _value(args[0], params)
            df, done = df.select(F.col("props")[key].alias("value")).filter("value is not null"), True
        elif name == "id":
            df, done = df.select(F.col("v").alias("value")), True
        elif name == "label":
            df, done = df.select(F.col("label").alias("value")), True
        elif name == "valueMap":
            df, done = df.select(F.col("props").alias("value")), True
        elif name == "count":
            df, done = df.agg(F.count(F.lit(1)).alias("value")), True
        elif name == "groupCount":
            c = F.col("v")
            if i < len(steps) and steps[i][0] == "by":
                a = steps[i][1][0]
                label = (isinstance(a, ast.Name) and a.id == "label") or (isinstance(a, ast.Constant) and a.value == "label")
                c = F.col("label") if label else F.col("props")[_value(a, params)]
                i += 1
            df, done = df.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("value")), True
        else:
            raise Unsupported(f"no step {name}")
    return df if done else df.select("v", "label", "props")
