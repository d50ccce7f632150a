"""Property graph from structural records: vertices, edges, deletes, capture and restore.

Tables are DataFrames: one per vertex type and one ``edges(etype, src, dst)``, whose ends are vertex keys. Every operator is a
projection or an equi-join, so the same plan serves a small tree and a very large one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions import identity as ident
from codeweave.functions import paths

VERTEX_TYPES = ["Directory", "File", "Function", "Method", "Class", "Interface", "Enum", "Origin"]
EDGE_TYPES = ["CONTAINS", "IMPORTS", "INHERITS", "IMPLEMENTS"]
ELEMENTS = ["Function", "Method", "Class", "Interface", "Enum"]

SCHEMAS = {
    "Directory": "path string, name string, depth int",
    "File": "path string, file_path string, name string, language string, domain string, summary string",
    "Function": "file_path string, name string, params string, line int, end_line int, is_exported boolean, is_async boolean, return_type string, anchor_key string, signature_hash string",
    "Method": "file_path string, class_name string, name string, params string, line int, end_line int, is_async boolean, return_type string, anchor_key string, signature_hash string",
    "Class": "file_path string, name string, line int, end_line int, anchor_key string, signature_hash string",
    "Interface": "file_path string, name string, line int, end_line int, anchor_key string, signature_hash string",
    "Enum": "file_path string, name string, line int, end_line int, anchor_key string, signature_hash string",
    "Origin": "id string, repo string, commit_sha string, parsed_at string, files int",
    "DiffLog": "project string, ts string, cause string, summary string, entries string",
    "edges": "etype string, src string, dst string",
}
# Annotation tables: declared for users who bring their own annotations; nothing here writes them.
ANNOTATION_SCHEMAS = {
    "Concept": "name string, description string, created_at timestamp",
    "Domain": "name string, description string",
    "Entity": "name string, kind string, description string",
    "Annotation": "target string, text string, author string, created_at timestamp, updated_at timestamp",
    "Chunk": "text string, position int, embedding string",
}


def element_key(kind: str, file: Column, name: Column, line: Column) -> Column:
    """Vertex key of an element: its type, file, name and line. Elements that share all of these share the key."""
    return F.concat_ws("\t", F.lit(kind), file, name, line.cast("string"))


def directories(files: DataFrame) -> DataFrame:
    """Distinct folders above ``files(path)``: path, name, depth."""
    return (files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
            .select("path", paths.basename(F.col("path")).alias("name"), paths.depth(F.col("path")).alias("depth")))


def file_vertices(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.select("path", p.alias("file_path"), paths.basename(p).alias("name"), F.coalesce("language", F.lit("unknown")).alias("language"), paths.domain(p).alias("domain"), F.lit(None).cast("string").alias("summary"))


def function_vertices(functions: DataFrame) -> DataFrame:
    return functions.filter("name is not null").select(
        "file_path", "name", "params", "line", "end_line", "is_exported", "is_async", "return_type",
        ident.anchor_key("function", F.col("file_path"), F.col("name")).alias("anchor_key"),
        ident.function_signature(*(F.col(c) for c in ("name", "params", "return_type", "is_async", "is_exported"))).alias("signature_hash"))


def method_vertices(methods: DataFrame) -> DataFrame:
    return methods.filter("name is not null").select(
        "file_path", "class_name", "name", "params", "line", "end_line", "is_async", "return_type",
        ident.anchor_key("method", F.col("file_path"), F.col("name"), F.col("class_name")).alias("anchor_key"),
        ident.method_signature(*(F.col(c) for c in ("class_name", "name", "params", "return_type", "is_async"))).alias("signature_hash"))


def class_vertices(classes: DataFrame) -> DataFrame:
    """``classes`` with ``parents array<string>`` as resolved and ``implements array<string>``."""
    return classes.filter("name is not null").select(
        "file_path", "name", "line", "end_line", ident.anchor_key("class", F.col("file_path"), F.col("name")).alias("anchor_key"),
        ident.class_signature(F.col("name"), F.col("parents"), F.col("implements")).alias("signature_hash"))


def plain_vertices(kind: str, rows: DataFrame) -> DataFrame:
    """Interfaces or enums: only exported ones become vertices."""
    return rows.filter("name is not null and is_exported").select(
        "file_path", "name", "line", F.lit(0).alias("end_line"), ident.anchor_key(kind, F.col("file_path"), F.col("name")).alias("anchor_key"),
        ident.plain_signature(kind, F.col("name")).alias("signature_hash"))


def _edge(etype: str, src: Column, dst: Column) -> list[Column]:
    return [F.lit(etype).alias("etype"), src.alias("src"), dst.alias("dst")]


def contains_directories(dirs: DataFrame) -> DataFrame:
    return dirs.filter("depth > 1").select(*_edge("CONTAINS", paths.dirname(F.col("path")), F.col("path")))


def contains_files(files: DataFrame) -> DataFrame:
    up = paths.dirname(F.col("path"))
    return files.filter(up != "").select(*_edge("CONTAINS", up, F.col("path")))


def contains_elements(files: DataFrame, kind: str, elements: DataFrame) -> DataFrame:
    """Joined on the file; elements with one key multiply as rows do. Files and elements grow with the tables: none goes through the driver."""
    held = elements.select("file_path", element_key(kind, F.col("file_path"), F.col("name"), F.col("line")).alias("dst"))
    return files.select(F.col("path").alias("file_path")).hint("merge").join(held.hint("merge"), "file_path").select(*_edge("CONTAINS", F.col("file_path"), F.col("dst")))


def imports(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resolved(file_path, resolved_file)``: a target once a source, never the file itself, both ends stored."""
    pairs = resolved.filter("resolved_file is not null and resolved_file <> file_path").select(F.col("file_path").alias("src"), F.col("resolved_file").alias("dst")).distinct()
    known = files.select("path").hint("merge")
    return pairs.join(known, pairs["src"] == known["path"], "left_semi").join(known, pairs["dst"] == known["path"], "left_semi").select(*_edge("IMPORTS", F.col("src"), F.col("dst")))


def inherits_by_name(classes: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """INHERITS in two tables that grow with the classes alone: heirs ``src, parent_file, parent_name`` and bearers of a name ``parent_file, parent_name, dst``.

    Their join has a row for every heir and every bearer of its parent's name, so it grows with the square of a name's classes.
    """
    known = parents.filter("confidence <> 'unresolved'").select("file_path", "name", "line", "parent_file", "parent_name")
    key = element_key("Class", F.col("file_path"), F.col("name"), F.col("line"))
    # all sides grow with the tables, and none goes through the driver
    heirs = known.join(classes.select("file_path", "name", "line", key.alias("src")).hint("merge"), ["file_path", "name", "line"]).select("src", "parent_file", "parent_name")
    return heirs, classes.select(F.col("file_path").alias("parent_file"), F.col("name").alias("parent_name"), key.alias("dst"))


def inherits(classes: DataFrame, parents: DataFrame) -> DataFrame:
    """``parents(file_path, name, line, parent_name, parent_file, confidence)``; the target is found by file and name, whatever its line."""
    heirs, bearers = inherits_by_name(classes, parents)
    return heirs.join(bearers.hint("merge"), ["parent_file", "parent_name"]).select(*_edge("INHERITS", F.col("src"), F.col("dst")))


def implements(classes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``classes(file_path, name, line, implements)``: an edge to every stored interface of that name in the project."""
    wanted = classes.select(element_key("Class", F.col("file_path"), F.col("name"), F.col("line")).alias("src"), F.explode("implements").alias("wanted"))
    offered = interfaces.select(F.col("name").alias("wanted"), element_key("Interface", F.col("file_path"), F.col("name"), F.col("line")).alias("dst"))
    return wanted.hint("merge").join(offered.hint("merge"), "wanted").select(*_edge("IMPLEMENTS", F.col("src"), F.col("dst")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def build(records: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a graph from records (``files functions methods classes interfaces enums imports parents``)."""
    classes = records["classes"]
    tables = {
        "Directory": directories(records["files"]), "File": file_vertices(records["files"]),
        "Function": function_vertices(records["functions"]), "Method": method_vertices(records["methods"]), "Class": class_vertices(classes),
        "Interface": plain_vertices("interface", records["interfaces"]), "Enum": plain_vertices("enum", records["enums"]),
    }
    tables["edges"] = union([
        contains_directories(tables["Directory"]), contains_files(tables["File"]), *(contains_elements(tables["File"], k, tables[k]) for k in ELEMENTS),
        imports(tables["File"], records["imports"]), inherits(tables["Class"], records["parents"]), implements(classes, tables["Interface"])])
    return tables


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``type, n`` of vertex types and edge types."""
    parts = [tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n") for t in VERTEX_TYPES if t in tables]
    return union([*parts, tables["edges"].groupBy(F.col("etype").alias("type")).agg(F.count(F.lit(1)).alias("n"))])


# Rewriting the part of a graph that belongs to some files ------------------------------------------------------------

def file_of(key: Column) -> Column:
    """File of a vertex key: second part of an element key, else the key itself."""
    return F.when(F.contains(key, F.lit("\t")), F.split(key, "\t")[1]).otherwise(key)


def delete_files(tables: dict[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
    """Without the files ``touched(path)``, their elements and all edges that had an end there; folders stay."""
    out = dict(tables)
    gone = touched.select("path")
    for t in ["File", *ELEMENTS]:
        column = "path" if t == "File" else "file_path"
        out[t] = tables[t].join(gone, tables[t][column] == gone["path"], "left_anti")
    e = tables["edges"].withColumn("__s", file_of(F.col("src"))).withColumn("__d", file_of(F.col("dst")))
    for end in ("__s", "__d"):
        e = e.join(gone, e[end] == gone["path"], "left_anti")
    out["edges"] = e.drop("__s", "__d")
    return out


def capture_incoming(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges of other vertices into the files ``touched(path)``, as names: ``type, src_file, src_name, dst_file, dst_name``."""
    name = lambda c: F.when(F.contains(F.col(c), F.lit("\t")), F.split(c, "\t")[2])
    named = edges.filter(F.col("etype").isin("IMPORTS", "INHERITS", "IMPLEMENTS")).select(
        F.col("etype").alias("type"), file_of(F.col("src")).alias("src_file"), name("src").alias("src_name"), file_of(F.col("dst")).alias("dst_file"), name("dst").alias("dst_name"))
    return named.join(touched.select("path"), F.col("dst_file") == F.col("path"), "left_semi")


def restore_edges(captured: DataFrame, tables: dict[str, DataFrame], rewritten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between vertices that exist again, and ``restored, dropped`` counts of the captured records.

    Records whose source file is in ``rewritten(path)`` are skipped: its edges have been made afresh. Equal records are one with a
    count, so counts don't depend on which task saw which row.
    """
    record = ["type", "src_file", "src_name", "dst_file", "dst_name"]
    rows = captured.join(rewritten.select("path"), captured["src_file"] == F.col("path"), "left_anti").groupBy(*record).agg(F.count(F.lit(1)).alias("__n"))
    key = lambda kind, t: t.select(F.lit(kind).alias("__k"), F.col("file_path").alias("__f"), F.col("name").alias("__n"), element_key(kind, F.col("file_path"), F.col("name"), F.col("line")).alias("__v"))
    files = tables["File"].select(F.lit("File").alias("__k"), F.col("path").alias("__f"), F.lit("").alias("__n"), F.col("path").alias("__v"))
    ends = union([files, key("Class", tables["Class"]), key("Interface", tables["Interface"])])
    src_kind = F.when(F.col("type") == "IMPORTS", "File").otherwise("Class")
    dst_kind = F.when(F.col("type") == "IMPORTS", "File").when(F.col("type") == "INHERITS", "Class").otherwise("Interface")
    s, d = ends.toDF("sk", "sf", "sn", "src"), ends.toDF("dk", "df", "dn", "dst")
    tied = (rows.join(s, (src_kind == F.col("sk")) & (F.col("src_file") == F.col("sf")) & (F.coalesce("src_name", F.lit("")) == F.col("sn")), "left")
            .join(d, (dst_kind == F.col("dk")) & (F.col("dst_file") == F.col("df")) & (F.coalesce("dst_name", F.lit("")) == F.col("dn")), "left"))
    done = F.col("src").isNotNull() & F.col("dst").isNotNull()
    each = tied.groupBy(*record, "__n").agg(F.max(done.cast("int")).alias("ok"))
    total = lambda ok: F.coalesce(F.sum(F.when(F.col("ok") == ok, F.col("__n"))), F.lit(0))
    return (tied.filter(done).select(F.col("type").alias("etype"), "src", "dst"), each.agg(total(1).alias("restored"), total(0).alias("dropped")))
