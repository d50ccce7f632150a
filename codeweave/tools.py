"""The read-and-parse tools: list, describe, schema, query, parse; and a command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import graph, incremental
from codeweave.query import cypher, gremlin, sql
from codeweave.sources.store import GraphStore

# File names by which a project is entered.
ENTRY_FILES = "main.py app.py index.ts index.js main.go main.rs Main.java server.ts server.js cli.py __main__.py manage.py lib.rs mod.rs".split()


class Tools:
    def __init__(self, spark: SparkSession, root: str, primary: str = "default"):
        self.spark, self.store, self.primary = spark, GraphStore(spark, root), primary

    def list_projects(self) -> dict:
        return {"primary": self.primary, "databases": self.store.projects()}

    def _tables(self, project: str) -> dict[str, DataFrame]:
        if self.store.version(project) is None:
            raise KeyError(f"unknown project: {project}")
        return self.store.tables(project)

    def describe_project(self, project: str) -> dict:
        """Counts by type, where it comes from, top folders, and files by which it is entered."""
        t = self._tables(project)
        counts = {r["type"]: r["n"] for r in graph.counts(t).collect()}  # one row a type
        tops = t["Directory"].filter("depth = 1").orderBy("path").limit(20).select("path")
        entries = t["File"].filter(F.col("name").isin(ENTRY_FILES)).orderBy("path").limit(20).select("path")
        return {"project": project, "counts": {k: counts.get(k, 0) for k in [*graph.VERTEX_TYPES, *graph.EDGE_TYPES]},
                "origin": self.store.origin(project) or "unknown: parsed before origins were kept", "directories": [r[0] for r in tops.collect()], "entry_files": [r[0] for r in entries.collect()]}

    def get_schema(self) -> DataFrame:
        """``type, kind, column, data_type`` of every table."""
        rows = [(t, "vertex", *c.split(" ")) for t in graph.VERTEX_TYPES for c in graph.SCHEMAS[t].split(", ")]
        rows += [(e, "edge", *c.split(" ")) for e in graph.EDGE_TYPES for c in ("src string", "dst string")]
        rows += [(a, "annotation", *c.split(" ")) for a, s in graph.ANNOTATION_SCHEMAS.items() for c in s.split(", ")]
        return self.spark.createDataFrame(rows, "type string, kind string, column string, data_type string")

    def query(self, text: str, language: str = "sql", params: dict | None = None, project: str | None = None) -> DataFrame:
        t = self._tables(project or self.primary)
        if language == "sql":
            sql.register(self.spark, t)
            return sql.query(self.spark, text, params)
        if language == "cypher":
            return cypher.query(sql.vertices(t), t["edges"], text, params)
        if language == "gremlin":
            return gremlin.query(sql.vertices(t), t["edges"], text, params)
        raise ValueError(f"unknown language: {language}; use sql, cypher or gremlin")

    def parse_repo(self, repo: str, project: str | None = None, progress: Callable[[str], None] | None = None, **options) -> dict:
        """A full rebuild unless ``incremental=True, clean=False`` is given."""
        return incremental.parse(self.spark, self.store, repo, project, progress=progress, **options)

    def call(self, tool: str, arguments: dict) -> dict:
        """A tool by name; errors come back as ``{"isError": True, ...}`` and not as exceptions."""
        known = {"list_projects": self.list_projects, "describe_project": self.describe_project, "get_schema": self.get_schema, "query": self.query, "parse_repo": self.parse_repo}
        if tool not in known:
            return {"isError": True, "error": f"unknown tool: {tool}"}
        try:
            out = known[tool](**arguments)
        except Exception as e:  # the caller decides what to do with any failure of a tool
            return {"isError": True, "error": f"{type(e).__name__}: {e}"}
        return {"result": [json.loads(r) for r in out.toJSON().collect()] if isinstance(out, DataFrame) else out}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeweave")
    p.add_argument("command", choices=["parse", "describe", "query", "projects"])
    p.add_argument("--root", required=True, help="folder of the graph store")
    p.add_argument("--repo")
    p.add_argument("--project")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--language", default="sql")
    p.add_argument("--text")
    a = p.parse_args(argv)
    tools = Tools(SparkSession.builder.appName("codeweave").getOrCreate(), a.root, a.project or "default")
    call = {"parse": ("parse_repo", {"repo": a.repo, "project": a.project, "clean": not a.incremental, "incremental": a.incremental}), "describe": ("describe_project", {"project": a.project}),
            "query": ("query", {"text": a.text, "language": a.language, "project": a.project}), "projects": ("list_projects", {})}[a.command]
    out = tools.call(*call)
    print(json.dumps(out, default=str, indent=1))
    return int("isError" in out)


if __name__ == "__main__":
    raise SystemExit(main())
