"""Symbol-level links between files: exported symbols against imported names, relative imports only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import registry
from codeweave.operators import resolve


def exported_symbols(records: dict[str, DataFrame]) -> DataFrame:
    """``name, kind, defined_in, line`` of exported functions, classes, interfaces and enums."""
    parts = [records[k].filter("is_exported").select("name", F.lit(kind).alias("kind"), F.col("file_path").alias("defined_in"), "line")
             for k, kind in (("functions", "function"), ("classes", "class"), ("interfaces", "interface"), ("enums", "enum"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def link_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with ``resolved_file`` by the relative rule alone: other sources stay null."""
    near = resolve.exact(resolve.beside(F.col("source"), F.col("file_path")), registry.RESOLVE_EXTENSIONS, registry.INDEX_FILES)
    cands = F.when(F.startswith("source", F.lit(".")), near).otherwise(resolve.nothing())
    once = imports.select("file_path", "source").distinct()
    found = resolve.first_found(once, ["file_path", "source"], cands, resolve.path_index(files))
    return imports.join(found, ["file_path", "source"], "left")


def link(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(import edges ``from_file, to_file, symbol_name, line``; unresolved ``file, symbol, source, line``)."""
    names = link_targets(imports, files).select("file_path", "source", "line", "resolved_file", F.explode("names").alias("symbol"))
    known = symbols.select(F.col("defined_in").alias("resolved_file"), F.col("name").alias("symbol")).distinct()
    edges = names.join(known, ["resolved_file", "symbol"], "left_semi").select(F.col("file_path").alias("from_file"), F.col("resolved_file").alias("to_file"), F.col("symbol").alias("symbol_name"), "line")
    missing = names.join(known, ["resolved_file", "symbol"], "left_anti").filter(F.startswith("source", F.lit("."))).select(F.col("file_path").alias("file"), "symbol", "source", "line")
    return edges, missing


def dependents(linked: DataFrame, file: str) -> DataFrame:
    return linked.filter(F.col("resolved_file") == file).select(F.col("file_path").alias("path")).distinct()


def dependencies(linked: DataFrame, file: str) -> DataFrame:
    return linked.filter((F.col("file_path") == file) & F.col("resolved_file").isNotNull()).select(F.col("resolved_file").alias("path")).distinct()
