"""A Cypher subset compiled to joins.

    MATCH (a:Label {k: v})-[:T|U*m..n]->(b:Label)<-[..]-(c), (d) WHERE conditions RETURN [DISTINCT] items ORDER BY .. SKIP .. LIMIT ..

Items are ``x``, ``x.prop``, ``count(*)``, ``count(x)``, ``count(DISTINCT x.p)``, ``collect(x.p)``, ``min max sum avg``, with ``AS``.
Conditions are comparisons of properties, literals and ``$params`` with ``= <> < <= > >= STARTS WITH, ENDS WITH, CONTAINS, IN [..], IS [NOT] NULL``,
joined by AND, OR, NOT and brackets. Anything else raises :class:`Unsupported`. Variable lengths are bounded by ``MAX_HOPS``
and follow each vertex once per start, as reachability does.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 15
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+(?:\.\d+)?)|(?P<id>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><>|<=|>=|->|<-|\.\.|[-()\[\]{}:,.|*=<>+/]))""")


class Unsupported(ValueError):
    pass


class Compiler:
    def __init__(self, vertices: DataFrame, edges: DataFrame, text: str, params: dict | None = None):
        self.vertices, self.edges, self.params = vertices, edges, params or {}
        self.toks, at = [], 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                if text[at:].strip():
                    raise Unsupported(f"cannot read: {text[at:at + 30]!r}")
                break
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i, self.names, self.df, self.anonymous = 0, [], None, 0
        # properties that the text speaks of, by name: only these travel with a vertex
        self.wanted: dict[str, dict[str, None]] = {}
        for (kind, name), (dot, between), (last, prop) in zip(self.toks, self.toks[1:], self.toks[2:]):
            if (kind, dot, between, last) == ("id", "op", ".", "id"):
                self.wanted.setdefault(name.strip("`"), {})[prop.strip("`")] = None

    # tokens ---------------------------------------------------------------------------------------------------------

    def peek(self, *values: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] != "str" and self.toks[self.i][1].upper() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            got = self.toks[self.i][1] if self.i < len(self.toks) else "the end"
            raise Unsupported(f"expected {value}, found {got}")

    def word(self) -> str:
        if self.i >= len(self.toks) or self.toks[self.i][0] != "id":
            raise Unsupported("expected a name")
        self.i += 1
        return self.toks[self.i - 1][1].strip("`")

    def literal(self):
        if self.i >= len(self.toks):
            raise Unsupported("expected a value")
        kind, v = self.toks[self.i]
        self.i += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "param":
            if v[1:] not in self.params:
                raise Unsupported(f"no parameter {v}")
            return self.params[v[1:]]
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        if v.lower() == "null":
            return None
        if v == "[":
            out = []
            while not self.take("]"):
                out.append(self.literal())
                self.take(",")
            return out
        raise Unsupported(f"expected a value, found {v}")

    # patterns -------------------------------------------------------------------------------------------------------

    def node(self) -> tuple[str, DataFrame]:
        self.need("(")
        name = ""
        if self.i < len(self.toks) and self.toks[self.i][0] == "id":
            name = self.word()
        if not name:
            self.anonymous += 1
            name = f"__{self.anonymous}"
        rows = self.vertices
        if self.take(":"):
            labels = [self.word()]
            while self.take("|"):
                self.take(":")
                labels.append(self.word())
            rows = rows.filter(F.col("label").isin(labels))
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                rows = rows.filter(F.col("props")[key] == F.lit(_text(self.literal())))
                self.take(",")
        self.need(")")
        props = [F.col("props")[p].alias(f"{name}.props.{p}") for p in self.wanted.get(name, {})]
        # vertices and edges grow with the tables: neither goes through the driver
        return name, rows.select(F.col("v").alias(name), F.col("label").alias(f"{name}.label"), *props).hint("merge")

    def bind(self, name: str, rows: DataFrame) -> None:
        if self.df is None:
            self.df, self.names = rows, [name]
        elif name in self.names:
            self.df = self.df.join(rows.select(F.col(name).alias("__same")).hint("merge"), F.col(f"`{name}`") == F.col("__same"), "left_semi")
        else:
            self.df, self.names = self.df.crossJoin(rows), [*self.names, name]

    def path(self) -> None:
        left, rows = self.node()
        self.bind(left, rows)
        while self.peek("-", "<-"):
            back = self.take("<-")
            if not back:
                self.need("-")
            types, low, high = [], 1, 1
            if self.take("["):
                if self.i < len(self.toks) and self.toks[self.i][0] == "id":
                    raise Unsupported("edges cannot be named")
                if self.take(":"):
                    types.append(self.word())
                    while self.take("|"):
                        self.take(":")
                        types.append(self.word())
                if self.take("*"):
                    low, high = 1, MAX_HOPS
                    if self.toks[self.i][0] == "num":
                        low = high = self.literal()
                    if self.take(".."):
                        high = self.literal() if self.toks[self.i][0] == "num" else MAX_HOPS
                self.need("]")
            if self.take("->"):
                if back:
                    raise Unsupported("an edge with two heads")
                way = "out"
            else:
                self.need("-")
                way = "in" if back else "both"
            if high > MAX_HOPS:
                raise Unsupported(f"at most {MAX_HOPS} hops")
            right, rows = self.node()
            reach = self.reach(left, types, low, high, way).hint("merge")
            met = self.df.join(reach, F.col(f"`{left}`") == F.col("__from")).drop("__from")
            if right in self.names:
                self.df = met.join(rows.select(F.col(right).alias("__same")).hint("merge"), F.col("__to") == F.col("__same"), "left_semi").filter(F.col("__to") == F.col(f"`{right}`")).drop("__to")
            else:
                self.df, self.names = met.join(rows, F.col("__to") == F.col(f"`{right}`")).drop("__to"), [*self.names, right]
            left = right

    def reach(self, left: str, types: list[str], low: int, high: int, way: str) -> DataFrame:
        e = self.edges.filter(F.col("etype").isin(types)) if types else self.edges
        out = e.select(F.col("src").alias("f"), F.col("dst").alias("t"))
        back = e.select(F.col("dst").alias("f"), F.col("src").alias("t"))
        one = {"out": out, "in": back, "both": out.unionByName(back)}[way]
        if (low, high) == (1, 1):
            return one.toDF("__from", "__to")
        start = self.df.select(F.col(f"`{left}`").alias("__from")).distinct()
        front = start.withColumn("__to", F.col("__from"))
        found = [front] if low == 0 else []
        for k in range(1, high + 1):
            front = front.join(one.hint("merge"), F.col("__to") == F.col("f")).select("__from", F.col("t").alias("__to")).distinct()
            if k >= low:
                found.append(front)
        return reduce(lambda a, b: a.unionByName(b), found).distinct()

    # expressions ----------------------------------------------------------------------------------------------------

    def value(self) -> tuple[Column, str]:
        kind, v = self.toks[self.i] if self.i < len(self.toks) else ("", "")
        if kind == "id" and v.lower() not in ("true", "false", "null"):
            name = self.word()
            if self.take("("):
                return self.call(name.lower())
            if name not in self.names:
                raise Unsupported(f"unknown name {name}")
            if self.take("."):
                prop = self.word()
                return F.col(f"`{name}.props.{prop}`"), f"{name}.{prop}"
            return F.col(f"`{name}`"), name
        x = self.literal()
        return F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)), str(x)

    def call(self, f: str) -> tuple[Column, str]:
        one = {"count": F.count, "collect": F.collect_list, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}
        plain = {"lower": F.lower, "upper": F.upper, "tolower": F.lower, "toupper": F.upper, "size": F.length, "tointeger": lambda c: c.cast("bigint")}
        if f == "labels":
            name = self.word()
            self.need(")")
            return F.col(f"`{name}.label`"), f"labels({name})"
        if f not in one and f not in plain:
            raise Unsupported(f"no function {f}")
        if f == "count" and self.take("*"):
            self.need(")")
            return F.count(F.lit(1)), "count(*)"
        distinct = self.take("DISTINCT")
        arg, said = self.value()
        self.need(")")
        if f in plain:
            return plain[f](arg), f"{f}({said})"
        self.aggregates = True
        if distinct:
            return (F.count_distinct(arg) if f == "count" else F.collect_set(arg)), f"{f}(DISTINCT {said})"
        return one[f](arg.cast("double") if f in ("sum", "avg") else arg), f"{f}({said})"

    def condition(self) -> Column:
        out = self.conjunction()
        while self.take("OR"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.take("AND"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        if self.take("NOT"):
            return ~self.negation()
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        left, _ = self.value()
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return left.isNotNull() if no else left.isNull()
        if self.take("IN"):
            return left.isin([_text(x) for x in self.literal()])
        for first, f in (("STARTS", F.startswith), ("ENDS", F.endswith)):
            if self.take(first):
                self.need("WITH")
                return f(left, self.value()[0])
        if self.take("CONTAINS"):
            return F.contains(left, self.value()[0])
        for op, f in (("=", "__eq__"), ("<>", "__ne__"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.take(op):
                kind = self.toks[self.i][0] if self.i < len(self.toks) else ""
                right, _ = self.value()
                number = kind == "num" or (kind == "param" and isinstance(self.params.get(self.toks[self.i - 1][1][1:]), (int, float)))
                if kind == "id" and self.toks[self.i - 1][1].lower() in ("true", "false"):
                    right = right.cast("string")
                return getattr(left.try_cast("double") if number else left, f)(right)
        raise Unsupported("expected a comparison")

    # the whole ------------------------------------------------------------------------------------------------------

    def run(self) -> DataFrame:
        self.need("MATCH")
        self.path()
        while self.take(",") or self.take("MATCH"):
            self.path()
        if self.take("WHERE"):
            self.df = self.df.filter(self.condition())
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        items, plain = [], []
        while True:
            at, self.aggregates = self.i, False
            c, said = self.value()
            grouped = self.toks[at][1].lower() in ("count", "collect", "min", "max", "sum", "avg") and self.i - at > 1 and self.toks[at + 1][1] == "("
            name = self.word() if self.take("AS") else said
            items.append((name, c, grouped))
            if not grouped:
                plain.append((name, c))
            if not self.take(","):
                break
        if any(g for _, _, g in items):
            cols = [c.alias(n) for n, c, g in items if g]
            out = self.df.groupBy(*[c.alias(n) for n, c in plain]).agg(*cols) if plain else self.df.agg(*cols)
            out = out.select(*[f"`{n}`" for n, _, _ in items])
        else:
            out = self.df.select(*[c.alias(n) for n, c, _ in items])
        if distinct:
            out = out.distinct()
        if self.take("ORDER"):
            self.need("BY")
            keys = []
            while True:
                _, said = self.value_name()
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                if said not in out.columns:
                    raise Unsupported(f"order by what is returned, not {said}")
                keys.append(F.col(f"`{said}`").desc() if down else F.col(f"`{said}`").asc())
                if not self.take(","):
                    break
            out = out.orderBy(*keys)
        if self.take("SKIP"):
            out = out.offset(self.literal())
        if self.take("LIMIT"):
            out = out.limit(self.literal())
        if self.i < len(self.toks):
            raise Unsupported(f"not supported: {self.toks[self.i][1]}")
        return out

    def value_name(self) -> tuple[None, str]:
        at = self.i
        if self.toks[at][0] == "id" and (at + 1 >= len(self.toks) or self.toks[at + 1][1] not in (".", "(")):
            return None, self.word()
        return None, self.value()[1]


def _text(v) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def query(vertices: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> DataFrame:
    return Compiler(vertices, edges, text, params).run()
