"""SQL over graph views named like the types; reads only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import graph


class ReadOnly(ValueError):
    """The text is not a query."""


def vertices(tables: dict[str, DataFrame]) -> DataFrame:
    """``v, label, props map<string,string>`` of all vertices."""
    parts = []
    for t in graph.VERTEX_TYPES:
        if t not in tables:
            continue
        df = tables[t]
        key = (F.col("path") if t in ("Directory", "File") else F.col("id") if t == "Origin"
               else graph.element_key(t, F.col("file_path"), F.col("name"), F.col("line")))
        entries = F.map_filter(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
        parts.append(df.select(key.alias("v"), F.lit(t).alias("label"), entries.alias("props")))
    return graph.union(parts)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views: one a type, ``edges`` and one an edge type, ``vertices``, and ``schema_types`` with record counts."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for e in graph.EDGE_TYPES:
        tables["edges"].filter(F.col("etype") == e).select("src", "dst").createOrReplaceTempView(e)
    vertices(tables).createOrReplaceTempView("vertices")
    kinds = {t: "vertex" for t in graph.VERTEX_TYPES} | {e: "edge" for e in graph.EDGE_TYPES}
    names = spark.createDataFrame(list(kinds.items()), "name string, type string")
    counted = graph.counts(tables)
    names.join(counted.withColumnRenamed("type", "name").withColumnRenamed("n", "records"), "name", "left").select("name", "type", F.coalesce("records", F.lit(0)).alias("records")).createOrReplaceTempView("schema_types")


def rewrite(text: str) -> str:
    """Bracket lists after IN, ``schema:types``, and the type called Function, as Spark SQL has them; strings are left alone."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", text)
    joined, strings = "", []
    for i, p in enumerate(parts):
        if i % 2:
            strings.append(p)
            joined += f"\x00{len(strings) - 1}\x00"
        else:
            joined += p
    joined = re.sub(r"(?i)\bIN\s*\[([^\]]*)\]", r"IN (\1)", joined)
    joined = re.sub(r"(?i)\bschema:types\b", "schema_types", joined)
    joined = re.sub(r"(?i)\b(from|join)\s+Function\b", r"\1 `Function`", joined)
    joined = re.sub(r":(?=[A-Za-z_]\w*)(?<!::)", ":", joined)
    return re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], joined)


_COMMAND = re.compile(r"Command|^Insert|^Create|^Drop|^Delete|^Update|^Merge|^Alter|^Replace|^Set|^Append|^Overwrite|^Truncate|^Cache|^Uncache|^Add|^Rename|^Show|^Repair|^Refresh|^Load|^Analyze|^Compound")


def query(spark: SparkSession, text: str, params: dict | None = None) -> DataFrame:
    """The rows of a query; a statement that changes anything is refused before it runs."""
    sql = rewrite(text)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = [plan.getClass().getSimpleName()]
    if _COMMAND.search(nodes[0]) and not nodes[0].startswith(("Describe", "ShowColumns", "ShowTables")):
        raise ReadOnly(f"only queries are allowed, not {nodes[0]}")
    return spark.sql(sql, args=params or {})
