"""Import and inheritance resolution as ranked equi-joins.

Every language rule turns an import into an ordered list of candidates ``(space, key)``. A space is an index over the file
universe with one path a key: exact paths, whole-segment suffixes of paths, suffixes of folders that hold files of an
extension, and folders above such files. So all languages share one join, and the first candidate that is found wins. The indexes
are made once by an explode and a map-side combined ``min``; a popular suffix has one row, so no key of the join is hot on that
side, and the import side may be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions import paths, registry

FOLDER_EXTENSIONS = [".go", ".swift", ".java", ".cs", ".kt", ".scala", ".rs"]
DOTTED = {"java": ".java", "c_sharp": ".cs", "kotlin": ".kt", "scala": ".scala"}


# Indexes -------------------------------------------------------------------------------------------------------------

def path_index(files: DataFrame) -> DataFrame:
    return files.select(F.lit("path").alias("space"), F.col("path").alias("key"), F.col("path").alias("resolved_file")).distinct()


def suffix_index(files: DataFrame) -> DataFrame:
    """The least path of every whole-segment suffix."""
    return (files.select(F.explode(paths.suffixes(F.col("path"))).alias("key"), "path").groupBy("key").agg(F.min("path").alias("resolved_file"))
            .select(F.lit("suffix").alias("space"), "key", "resolved_file"))


def folder_index(files: DataFrame, ext: str) -> DataFrame:
    """For every suffix of a folder that directly holds ``ext`` files: the first file of the first such folder."""
    firsts = files.filter(F.endswith("path", F.lit(ext))).groupBy(paths.dirname(F.col("path")).alias("folder")).agg(F.min("path").alias("first"))
    return (firsts.select(F.explode(paths.suffixes(F.col("folder"))).alias("key"), F.struct("folder", "first").alias("x")).groupBy("key").agg(F.min("x").alias("x"))
            .select(F.lit("folder" + ext).alias("space"), "key", F.col("x.first").alias("resolved_file")))


def below_index(files: DataFrame, ext: str) -> DataFrame:
    """The least ``ext`` file anywhere below a folder."""
    return (files.filter(F.endswith("path", F.lit(ext))).select(F.explode(paths.ancestors(F.col("path"))).alias("key"), "path").groupBy("key")
            .agg(F.min("path").alias("resolved_file")).select(F.lit("below" + ext).alias("space"), "key", "resolved_file"))


def indexes(files: DataFrame) -> DataFrame:
    out = path_index(files).unionByName(suffix_index(files)).unionByName(below_index(files, ".rs"))
    for ext in FOLDER_EXTENSIONS:
        out = out.unionByName(folder_index(files, ext))
    return out


# Candidates ----------------------------------------------------------------------------------------------------------

def _in(space: str | Column, key: Column) -> Column:
    return F.struct((F.lit(space) if isinstance(space, str) else space).alias("space"), key.alias("key"))


def nothing() -> Column:
    return F.array().cast("array<struct<space:string,key:string>>")


def exact(base: Column, exts: list[str], index_files: list[str]) -> Column:
    """The path itself, then with each extension, then each index file in it."""
    tails = ["", *exts, *("/" + i for i in index_files)]
    return paths.let(base, lambda b: F.transform(F.array(*map(F.lit, tails)), lambda tail: _in("path", F.concat(b, tail))))


def by_suffix(target: Column, exts: list[str] | None = None) -> Column:
    """Suffixes of the target, the longest first, each with every extension in turn."""
    return F.flatten(F.transform(paths.suffixes(target), lambda s: F.array(*(_in("suffix", F.concat(s, F.lit(e))) for e in (exts or [""])))))


def by_folder(target: Column, ext: str) -> Column:
    return F.transform(paths.suffixes(target), lambda s: _in("folder" + ext, s))


def python_candidates(source: Column, names: Column, from_file: Column) -> Column:
    rest = F.ltrim(source, F.lit("."))
    dots = F.length(source) - F.length(rest)
    here = paths.dirname(from_file, F.greatest(dots, F.lit(1)))
    under = lambda tail: exact(F.when(here == "", tail).otherwise(F.concat(here, F.lit("/"), tail)), [".py"], ["__init__.py"])
    own = F.array(_in("path", F.when(here == "", F.lit("__init__.py")).otherwise(F.concat(here, F.lit("/__init__.py")))))
    bare = F.concat(F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: under(F.replace(n, F.lit("."), F.lit("/"))))), own)
    return F.when(dots == 0, exact(F.replace(source, F.lit("."), F.lit("/")), [".py"], ["__init__.py"])).when(rest == "", bare).otherwise(under(F.replace(rest, F.lit("."), F.lit("/"))))


def dotted_candidates(source: Column, names: Column, ext: str) -> Column:
    path = F.replace(source, F.lit("."), F.lit("/"))
    return F.when(names == F.array(F.lit("*")), by_folder(path, ext)).otherwise(by_suffix(F.concat(path, F.lit(ext))))


def rust_candidates(source: Column, names: Column, from_file: Column) -> Column:
    parts = F.split(source, "::")
    first, rest = parts[0], F.slice(parts, F.lit(2), F.size(parts))
    wild = F.coalesce(F.startswith(F.get(names, F.lit(0)), F.lit("*")), F.lit(False))
    joined = F.array_join(rest, "/")
    crate = F.when(wild, by_folder(joined, ".rs")).otherwise(by_suffix(joined, [".rs", "/mod.rs"]))
    # further ``super`` segments right after the first climb one folder each
    more = F.aggregate(rest, F.lit(0), lambda n, x: F.when((x == "super") & (n >= 0), n + 1).when(n >= 0, -n - 1).otherwise(n), lambda n: F.when(n >= 0, n).otherwise(-n - 1))
    climb = F.when(first == "self", F.lit(1)).otherwise(F.when(paths.basename(from_file).isin("mod.rs", "lib.rs", "main.rs"), 2).otherwise(1) + more)
    tail = F.when(first == "self", rest).otherwise(F.slice(rest, more + 1, F.size(rest)))
    here = paths.dirname(from_file, climb)
    path = F.when(here == "", F.array_join(tail, "/")).otherwise(F.concat(here, F.lit("/"), F.array_join(tail, "/")))
    near = F.when(F.size(tail) == 0, nothing()).when(wild, F.array(_in("below.rs", path))).otherwise(exact(path, [".rs"], ["mod.rs"]))
    return F.when((first == "crate") & (F.size(rest) > 0), crate).when(first.isin("super", "self"), near).otherwise(nothing())


def beside(source: Column, from_file: Column) -> Column:
    return paths.normalised(paths.joined(paths.dirname(from_file), source))


def dart_candidates(source: Column, from_file: Column, package: str | None) -> Column:
    own = F.lit(f"package:{package}/") if package else F.lit(None).cast("string")
    inside = by_suffix(F.concat(F.lit("lib/"), F.substring(source, len(f"package:{package}/") + 1, 1 << 20)))
    return F.when(F.startswith(source, F.lit("dart:")), nothing()).when(F.coalesce(F.startswith(source, own), F.lit(False)), inside).when(
        F.startswith(source, F.lit("package:")), nothing()).otherwise(exact(beside(source, from_file), [".dart"], []))


def php_candidates(source: Column, from_file: Column) -> Column:
    near = beside(source, from_file)
    spaced = F.concat(F.replace(source, F.lit("\\"), F.lit("/")), F.lit(".php"))
    more = F.when(F.endswith(near, F.lit(".php")), nothing()).otherwise(F.array(_in("path", F.concat(near, F.lit(".php")))))
    return F.when(F.contains(source, F.lit("\\")), by_suffix(spaced)).when(
        source.rlike(r"^[./]"), F.concat(F.array(_in("path", near)), more)).when(F.endswith(source, F.lit(".php")), by_suffix(source)).otherwise(by_suffix(source, [".php"]))


def ruby_candidates(source: Column, kind: Column, from_file: Column) -> Column:
    near = beside(source, from_file)
    full = F.when(F.endswith(near, F.lit(".rb")), near).otherwise(F.concat(near, F.lit(".rb")))
    return F.when(kind.eqNullSafe(F.lit("require_relative")), F.array(_in("path", full))).when(F.endswith(source, F.lit(".rb")), by_suffix(source)).otherwise(by_suffix(source, [".rb"]))


def c_candidates(source: Column, kind: Column, from_file: Column) -> Column:
    return F.when(kind.eqNullSafe(F.lit("system")), nothing()).otherwise(F.concat(F.array(_in("path", beside(source, from_file))), by_suffix(source)))


def alias_target(source: Column, aliases: dict[str, str]) -> Column:
    """The source with its longest alias prefix replaced; unchanged without one; aliases are few and driver-side."""
    out = None
    for prefix in sorted(aliases, key=lambda a: (-len(a), list(aliases).index(a))):
        hit, value = F.startswith(source, F.lit(prefix)), F.concat(F.lit(aliases[prefix]), F.substring(source, len(prefix) + 1, 1 << 20))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return source if out is None else out.otherwise(source)


def js_candidates(source: Column, from_file: Column, aliases: dict[str, str]) -> Column:
    aliased = paths.any_of(*(F.startswith(source, F.lit(a)) for a in aliases))
    target = alias_target(source, aliases)
    near = F.when(F.startswith(target, F.lit(".")), beside(target, from_file)).otherwise(F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), r"^\./", ""))
    return F.when(F.startswith(source, F.lit(".")) | aliased, exact(near, registry.RESOLVE_EXTENSIONS, registry.INDEX_FILES)).otherwise(nothing())


def candidates(aliases: dict[str, str], dart_package: str | None) -> Column:
    """Candidates of an import row (``language, source, names, kind, file_path``)."""
    lang, source, names, kind, at = (F.col(c) for c in ("language", "source", "names", "kind", "file_path"))
    out = F.when(F.coalesce(source, F.lit("")) == "", nothing()).when(lang == "python", python_candidates(source, names, at))
    for one in ("go", "swift"):
        out = out.when(lang == one, by_folder(source, "." + one))
    for one, ext in DOTTED.items():
        out = out.when(lang == one, dotted_candidates(source, names, ext))
    out = out.when(lang == "rust", rust_candidates(source, names, at)).when(lang == "dart", dart_candidates(source, at, dart_package))
    out = out.when(lang == "php", php_candidates(source, at)).when(lang == "ruby", ruby_candidates(source, kind, at)).when(lang.isin("c", "cpp"), c_candidates(source, kind, at))
    return out.otherwise(js_candidates(source, at, aliases))


def first_found(rows: DataFrame, id_cols: list[str], cands: Column, index: DataFrame) -> DataFrame:
    """``id_cols, resolved_file`` of the first candidate that the index has; rows without one are absent."""
    listed = rows.select(*id_cols, F.posexplode(cands).alias("at", "c")).select(*id_cols, "at", "c.space", "c.key")
    return listed.join(index, ["space", "key"]).groupBy(*id_cols).agg(F.min_by("resolved_file", "at").alias("resolved_file"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, dart_package: str | None = None) -> DataFrame:
    """``imports(file_path, language, source, names, line, kind)`` with ``resolved_file``; equal imports are resolved once."""
    key = ["file_path", "language", "source", "names", "kind"]
    once = imports.select(*key).distinct()
    # a JSON key keeps nulls apart and joins plainly
    token = F.to_json(F.struct(*key))
    found = first_found(once.withColumn("__t", token), ["__t"], candidates(registry.DEFAULT_ALIASES if aliases is None else aliases, dart_package), indexes(files))
    return imports.withColumn("__t", token).join(found, "__t", "left").drop("__t")


# Inheritance ---------------------------------------------------------------------------------------------------------

def resolve_inheritance(wanted: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Parents of classes and how sure each is.

    ``wanted(file_path, name, line, pos, parent)``; ``symbols(name, file_path, line, parse_order)``: class definitions in the
    order they were read; ``imports(file_path, resolved_file, imported, imp_order)``: one row an imported name. Rules in
    order: defined in the same file (high); imported by name from a file that defines it (high); the only definition
    anywhere (medium) or the first of several (low); else unresolved with the parent as written.
    """
    ask = wanted.withColumn("simple", paths.simple_name(F.col("parent")))
    asked = ask.select("file_path", "parent", "simple").distinct()  # equal questions of a file are answered once
    # of equal names in one file only the first can win, so no join multiplies; all sides grow with the tables, and none goes through the driver
    firsts = (symbols.groupBy(F.col("name").alias("sym_name"), F.col("file_path").alias("sym_file")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("parse_order", "line")).alias("first"))
              .select("sym_name", "sym_file", "n", F.col("first.parse_order").alias("sym_order"), F.col("first.line").alias("sym_line")).hint("merge"))
    local = (asked.join(firsts, (F.col("simple") == F.col("sym_name")) & (F.col("file_path") == F.col("sym_file")))
             .select("file_path", "parent", F.struct(F.lit(1).alias("rule"), F.lit(0).cast("long").alias("o"), F.col("sym_order").alias("s"), "sym_file", "sym_line", F.lit("high").alias("confidence")).alias("hit")))
    named = imports.filter("resolved_file is not null").select(F.col("file_path").alias("imp_file"), "resolved_file", "imported", "imp_order").hint("merge")
    brought = (asked.withColumn("asked", F.explode(F.array_distinct(F.array("simple", "parent"))))
               .join(named, (F.col("file_path") == F.col("imp_file")) & (F.col("asked") == F.col("imported")))
               .join(firsts, (F.col("simple") == F.col("sym_name")) & (F.col("resolved_file") == F.col("sym_file")))
               .select("file_path", "parent", F.struct(F.lit(2).alias("rule"), F.col("imp_order").cast("long").alias("o"), F.col("sym_order").alias("s"), "sym_file", "sym_line", F.lit("high").alias("confidence")).alias("hit")))
    anywhere = firsts.groupBy("sym_name").agg(F.sum("n").alias("n"), F.min(F.struct("sym_order", "sym_file", "sym_line")).alias("first")).hint("merge")
    other = (asked.join(anywhere, F.col("simple") == F.col("sym_name")).select("file_path", "parent", F.struct(
        F.lit(3).alias("rule"), F.lit(0).cast("long").alias("o"), F.col("first.sym_order").alias("s"), F.col("first.sym_file").alias("sym_file"), F.col("first.sym_line").alias("sym_line"),
        F.when(F.col("n") == 1, "medium").otherwise("low").alias("confidence")).alias("hit")))
    best = local.unionByName(brought).unionByName(other).groupBy("file_path", "parent").agg(F.min("hit").alias("hit")).hint("merge")
    found = F.col("hit").isNotNull()
    return ask.join(best, ["file_path", "parent"], "left").select(
        "file_path", "name", "line", "pos", "parent", F.when(found, F.col("simple")).otherwise(F.col("parent")).alias("parent_name"),
        F.col("hit.sym_file").alias("parent_file"), F.col("hit.sym_line").alias("parent_line"), F.coalesce("hit.confidence", F.lit("unresolved")).alias("confidence"))


def merge_symbols(parsed: DataFrame, stored: DataFrame, parsed_files: DataFrame) -> DataFrame:
    """Symbols of this parse and, after them in order, those the graph has of files that were not parsed."""
    kept = stored.filter("name is not null and file_path is not null").join(parsed_files.select("path"), F.col("file_path") == F.col("path"), "left_anti")
    shift = parsed.agg(F.coalesce(F.max("parse_order"), F.lit(-1)).alias("m"))
    later = kept.crossJoin(F.broadcast(shift)).select(  # one row
        "name", "file_path", F.coalesce("line", F.lit(0)).alias("line"), (F.col("m") + 1 + F.coalesce("parse_order", F.lit(0))).alias("parse_order"))
    return parsed.select("name", "file_path", "line", "parse_order").unionByName(later)
