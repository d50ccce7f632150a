"""Registered queries: every graph operator on the fixture projection, with its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.functions import identity as ident
from codeweave.functions import paths, registry
from codeweave.operators import diff, graph, incremental, linker, resolve, traverse
from codeweave.plans.fixture import Fixture, table
from codeweave.sources.store import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The projection in SQL, for the oracles.
_SQL = {
    "places": "places as (select n_nationkey, r_name || '/' || n_name as folder, r_name from nation join region on n_regionkey = r_regionkey)",
    "cfiles": "cfiles as (select c_custkey, folder || '/' || c_name as path, folder from customer join places on c_nationkey = n_nationkey)",
    "sfiles": "sfiles as (select s_suppkey, folder || '/' || s_name as path, folder from supplier join places on s_nationkey = n_nationkey)",
    "files": "files as (select path, folder from cfiles union all select path, folder from sfiles)",
    "dirs": "dirs as (select distinct folder as path from files union select distinct split_part(folder, '/', 1) from files)",
    "funcs": """funcs as (select path as file_path, 'o' || o_orderkey as name, o_orderpriority as params, o_orderstatus as return_type, o_orderkey,
        cast(o_orderkey % 1000 as integer) as line, o_orderkey % 2 = 0 as is_exported, o_orderkey % 3 = 0 as is_async
        from orders join cfiles on o_custkey = c_custkey)""",
    "meths": """meths as (select path as file_path, 'o' || l_orderkey as class_name, cast(l_linenumber as varchar) as name, l_returnflag as params,
        l_linestatus as return_type, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey join cfiles on o_custkey = c_custkey)""",
    "imps": """imps as (select distinct c.path as src, s.path as dst from lineitem join orders on l_orderkey = o_orderkey join cfiles c on o_custkey = c_custkey
        join sfiles s on l_suppkey = s_suppkey)""",
    "classes": """classes as (select p_brand as file_path, case when p_partkey % 5 = 0 then 'U' || p_partkey else p_name end as name, cast(p_partkey as integer) as line, p_partkey as parse_order, p_size,
        case p_partkey % 4 when 0 then 'U' || ((p_partkey * 7 % 40) * 5) when 1 then 'ext.' || p_type when 2 then 'red ' || split_part(p_name, ' ', 2)
        else 'mod.U' || ((p_partkey * 3 % 40) * 5) end as parent, p_partkey from part)""",
    "ifaces": "ifaces as (select p_brand as file_path, 'I_' || p_size as name, cast(p_partkey as integer) as line, p_partkey % 100 = 0 as is_exported from part where p_partkey % 50 = 0)",
    "resolved": """asked as (select c.*, case when contains(parent, '.') then split_part(parent, '.', 2) else parent end as simple from classes c),
        hits as (
          select a.parse_order as id, 1 as rule, s.parse_order as o, s.file_path as pf, s.line as pl, 'high' as confidence from asked a join classes s on s.name = a.simple and s.file_path = a.file_path
          union all select a.parse_order, 2, s.parse_order, s.file_path, s.line, 'high' from asked a join classes s on s.name = a.simple
            and s.file_path = 'Brand#' || (cast(replace(a.file_path, 'Brand#', '') as integer) % 25 + 1)
          union all select a.parse_order, 3, s.parse_order, s.file_path, s.line, case when n = 1 then 'medium' else 'low' end from asked a join classes s on s.name = a.simple
            join (select name, count(*) as n from classes group by name) g on g.name = a.simple),
        resolved as (select a.file_path, a.name, a.line, case when h.id is null then a.parent else a.simple end as parent_name, h.pf as parent_file, h.pl as parent_line,
          coalesce(h.confidence, 'unresolved') as confidence
          from asked a left join (select *, row_number() over (partition by id order by rule, o) as rn from hits) h on h.id = a.parse_order and h.rn = 1)""",
    "pages_f": """pages_f as (select distinct regexp_extract(url, '^https?://([^/?#]*)', 1) || rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') as path from pages)""",
}


def _with(names: str, body: str) -> str:
    return "with " + ",\n".join(_SQL[n] for n in names.split()) + "\n" + body


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Fixture], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f
    return keep


def _bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _rebuilt(x: Fixture) -> dict[str, DataFrame]:
    """All tables of the fixture graph."""
    parents = _inheritance(x).select("file_path", "name", "line", "parent_name", "parent_file", "confidence")
    none = "file_path string, name string, line int, is_exported boolean"
    return graph.build({
        "files": x.files(), "functions": x.functions(), "methods": x.methods(), "classes": x.classes(), "interfaces": x.interfaces(),
        "enums": x.spark.createDataFrame([], none), "imports": x.imports(), "parents": parents})


def _inheritance(x: Fixture) -> DataFrame:
    c = x.classes()
    imported = x.class_imports().join(c.select(F.col("file_path").alias("resolved_file"), F.col("name").alias("imported")).distinct().hint("merge"), "resolved_file").withColumn("imp_order", F.lit(0))
    wanted = c.select("file_path", "name", "line", F.lit(0).alias("pos"), "parent")
    return resolve.resolve_inheritance(wanted, c.select("name", "file_path", "line", "parse_order"), imported)


def _page_files(x: Fixture) -> DataFrame:
    url = F.col("url")
    return x.t("pages").select(F.concat(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/+$", "")).alias("path")).distinct()


# Counts and folders (Q2, T3, T4, T7, P4, P5, G1, G2) -----------------------------------------------------------------

@query("vertex_counts_by_type", _with("places cfiles sfiles files dirs classes ifaces", """
    select 'Directory' as type, count(*)::bigint as n from dirs union all select 'File', count(*) from files union all select 'Function', count(*) from orders
    union all select 'Method', count(*) from lineitem union all select 'Class', count(*) from classes union all select 'Interface', count(*) from ifaces where is_exported
    union all select 'Enum', 0"""))
def vertex_counts(x: Fixture) -> DataFrame:
    tables = _rebuilt(x)
    parts = [tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n") for t in graph.VERTEX_TYPES if t in tables]
    return graph.union(parts)


@query("edge_counts_by_type", _with("places cfiles sfiles files dirs imps classes ifaces resolved", """
    select 'CONTAINS' as type, (select count(*) from dirs where contains(path, '/')) + (select count(*) from files) + (select count(*) from orders) + (select count(*) from lineitem)
      + 0 as n
    union all select 'IMPORTS', count(*) from imps
    union all select 'INHERITS', (select count(*) from resolved r join classes s on s.file_path = r.file_path and s.name = r.name and s.line = r.line
        join classes t on t.file_path = r.parent_file and t.name = r.parent_name where r.confidence <> 'unresolved')
    union all select 'IMPLEMENTS', (select count(*) from classes c join ifaces i on i.name = 'I_' || c.p_size where c.p_partkey % 3 = 0 and i.is_exported)"""))
def edge_counts(x: Fixture) -> DataFrame:
    return _bigint(_rebuilt(x)["edges"].groupBy(F.col("etype").alias("type")).agg(F.count(F.lit(1)).alias("n")), "n")


@query("top_directories", _with("places cfiles sfiles files dirs", "select path, path as name, 1::integer as depth from dirs where not contains(path, '/') order by path limit 20"))
def top_directories(x: Fixture) -> DataFrame:
    return graph.directories(x.files()).filter("depth = 1").orderBy("path").limit(20)


@query("directory_expand", _with("places cfiles sfiles files dirs", """
    select path, case when contains(path, '/') then split_part(path, '/', 2) else path end as name, (length(path) - length(replace(path, '/', '')) + 1)::integer as depth from dirs"""))
def directory_expand(x: Fixture) -> DataFrame:
    return graph.directories(x.files())


@query("file_domain", _with("places cfiles sfiles files", "select split_part(path, '/', 1) as domain, count(*)::bigint as n from files group by 1"))
def file_domain(x: Fixture) -> DataFrame:
    return graph.file_vertices(x.files()).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("file_vertices", _with("places cfiles sfiles files", """select path, path as file_path, split_part(path, '/', 3) as name, 'unknown' as language, split_part(path, '/', 1) as domain,
    cast(null as varchar) as summary from files"""))
def file_rows(x: Fixture) -> DataFrame:
    return graph.file_vertices(x.files())


# Names and filters (P1-P3, F1-F9) ------------------------------------------------------------------------------------

@query("url_language_detect", _with("pages_f", """
    , p as (select path, regexp_extract(path, '[^/]*$') as name from pages_f), e as (select path, lower(regexp_extract(name, '^\\.*[^.].*?(\\.[^.]*)$', 1)) as ext from p)
    select path, ext, case ext when '.html' then 'html' when '.htm' then 'html' when '.php' then 'php' when '.js' then 'javascript' when '.py' then 'python' end as language from e""").replace("as path from pages)\n\n    , p as", "as path from pages), p as"))
def url_language(x: Fixture) -> DataFrame:
    f = _page_files(x)
    return f.select("path", F.lower(paths.extension(F.col("path"))).alias("ext"), paths.language(F.col("path")).alias("language"))


_NAMES = ["src/a.py", "src/.env", "src/.gitignore", "lib/x.min.js", "node_modules/a/b.js", "dist/app.js", ".git/config", "yarn.lock", "img/logo.PNG", "a/b/Dockerfile", "Makefile", "README", "gen/user_pb2.py", "UPPER.JS",
          "src/.hidden/x.ts", "pkg/a-lock.yaml", "build.gradle", "x/y/z.tar.gz", "api/v1.generated.ts", "t/.eslintrc.json", "deep/vendor/q.go", "a.b/c", "noext.", "web/index.tsx"]
# Expected: folder, lock, generated, hidden, extension, language; held as rows so that both engines can state them.
_EXPECTED = ["00000 python", "00010", "00000 gitignore", "00100 javascript", "10000 javascript", "10000 javascript", "10000", "01000", "00001", "00000 dockerfile", "00000 make", "00000", "00100 python", "00000 javascript",
             "10000 typescript", "00100 yaml", "00000", "00001", "00100 typescript", "00000 json", "10000 go", "00000", "00000", "00000 tsx"]


@query("blocklist_filter", "select * from (values " + ", ".join(
    f"('{n}', " + ", ".join("true" if c == "1" else "false" for c in e[:5]) + ", " + (f"'{e[6:]}'" if e[6:] else "cast(null as varchar)") + ")" for n, e in zip(_NAMES, _EXPECTED))
    + ") t(path, in_folder, is_lock, is_generated, is_hidden, is_blocked, language)")
def blocklist(x: Fixture) -> DataFrame:
    p = F.col("path")
    return x.spark.createDataFrame([(n,) for n in _NAMES], "path string").select(
        "path", paths.blocked_folder(p).alias("in_folder"), paths.lock_file(p).alias("is_lock"), paths.generated_file(p).alias("is_generated"), paths.hidden_file(p).alias("is_hidden"),
        paths.blocked_extension(p).alias("is_blocked"), paths.language(p).alias("language"))


@query("path_normalise", """select * from (values ('a/b', '../c', 'a/c'), ('a', './b/./c', 'a/b/c'), ('', '../x', '../x'), ('a/b', '../../../y', '../y'), ('a', '..', '.'), ('a/b', '/abs//z', '/abs/z'), ('a', 'b//c/', 'a/b/c'))
    t(folder, rest, path)""")
def normalise(x: Fixture) -> DataFrame:
    rows = [("a/b", "../c"), ("a", "./b/./c"), ("", "../x"), ("a/b", "../../../y"), ("a", ".."), ("a/b", "/abs//z"), ("a", "b//c/")]
    return x.spark.createDataFrame(rows, "folder string, rest string").select("folder", "rest", paths.normalised(paths.joined(F.col("folder"), F.col("rest"))).alias("path"))


# Edges (G4-G9) -------------------------------------------------------------------------------------------------------

@query("contains_edges", _with("places cfiles sfiles files dirs funcs", """
    select 'CONTAINS' as etype, split_part(path, '/', 1) as src, path as dst from dirs where contains(path, '/')
    union all select 'CONTAINS', folder, path from files
    union all select 'CONTAINS', f.path, 'Function' || chr(9) || file_path || chr(9) || name || chr(9) || line from files f join funcs on f.path = file_path"""))
def contains_edges(x: Fixture) -> DataFrame:
    files = x.files()
    return graph.union([graph.contains_directories(graph.directories(files)), graph.contains_files(files), graph.contains_elements(files, "Function", x.functions())])


@query("contains_depth", _with("places cfiles sfiles files dirs", """
    select 'Directory' as type, (1 + length(path) - length(replace(path, '/', '')))::bigint as depth, count(*)::bigint as n from dirs group by 2 union all select 'File', 3, count(*) from files"""))
def contains_depth(x: Fixture) -> DataFrame:
    d = graph.directories(x.files()).select(F.lit("Directory").alias("type"), F.col("depth").cast("bigint").alias("depth"))
    f = x.files().select(F.lit("File").alias("type"), paths.depth(F.col("path")).cast("bigint").alias("depth"))
    return d.unionByName(f).groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("imports_edges", _with("places cfiles sfiles imps", "select 'IMPORTS' as etype, src, dst from imps"))
def imports_edges(x: Fixture) -> DataFrame:
    return graph.imports(x.files(), x.imports())


@query("imports_fan_in", _with("places cfiles sfiles imps", "select dst as path, count(*)::bigint as fan_in from imps group by dst"))
def fan_in(x: Fixture) -> DataFrame:
    return graph.imports(x.files(), x.imports()).groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))


@query("imports_fan_out", _with("places cfiles sfiles imps", "select src as path, count(*)::bigint as fan_out from imps group by src"))
def fan_out(x: Fixture) -> DataFrame:
    return graph.imports(x.files(), x.imports()).groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))


@query("degree_distribution", _with("places cfiles sfiles imps", """
    , d as (select v, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select src as v, 0 as i, 1 as o from imps union all select dst, 1, 0 from imps) group by v)
    select fan_in, fan_out, count(*)::bigint as n from d group by 1, 2""").replace("l_suppkey = s_suppkey)\n\n    ,", "l_suppkey = s_suppkey),"))
def degree_distribution(x: Fixture) -> DataFrame:
    return traverse.degrees(graph.imports(x.files(), x.imports())).groupBy("fan_in", "fan_out").agg(F.count(F.lit(1)).alias("n"))


@query("inherits_edges", _with("classes resolved", """
    select 'INHERITS' as etype, 'Class' || chr(9) || r.file_path || chr(9) || r.name || chr(9) || r.line as src, 'Class' || chr(9) || t.file_path || chr(9) || t.name || chr(9) || t.line as dst
    from resolved r join classes t on t.file_path = r.parent_file and t.name = r.parent_name where r.confidence <> 'unresolved'"""))
def inherits_edges(x: Fixture) -> DataFrame:
    return graph.inherits(x.classes(), _inheritance(x))


@query("implements_fanout", _with("classes ifaces", """
    select 'IMPLEMENTS' as etype, 'Class' || chr(9) || c.file_path || chr(9) || c.name || chr(9) || c.line as src, 'Interface' || chr(9) || i.file_path || chr(9) || i.name || chr(9) || i.line as dst
    from classes c join ifaces i on i.name = 'I_' || c.p_size where c.p_partkey % 3 = 0 and i.is_exported"""))
def implements_fanout(x: Fixture) -> DataFrame:
    return graph.implements(x.classes(), graph.plain_vertices("interface", x.interfaces()))


# Resolution (R1-R3, R13, R20) ----------------------------------------------------------------------------------------

@query("inheritance_resolve", _with("classes resolved", "select file_path, name, line, parent_name, parent_file, coalesce(parent_line, -1)::integer as parent_line, confidence from resolved"))
def inheritance_resolve(x: Fixture) -> DataFrame:
    return _inheritance(x).select("file_path", "name", "line", "parent_name", "parent_file", F.coalesce("parent_line", F.lit(-1)).alias("parent_line"), "confidence")


@query("confidence_histogram", _with("classes resolved", "select confidence, count(*)::bigint as n from resolved group by 1"))
def confidence_histogram(x: Fixture) -> DataFrame:
    return _inheritance(x).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


_ASKED = "asked as (select distinct n_name || '/' || c_name as target from cfiles2 union all select 'x/y/' || s_name from supplier union all select 'none/' || r_name from region)"


@query("suffix_resolve_files", _with("places cfiles sfiles files", f"""
    , cfiles2 as (select n_name, c_name from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0), {_ASKED},
    parts as (select target, str_split(target, '/') as p from asked), cand as (select target, i, array_to_string(p[i:], '/') as suffix from (select target, p, unnest(generate_series(1, len(p))) as i from parts)),
    idx as (select array_to_string(p[i:], '/') as suffix, min(path) as path from (select path, p, unnest(generate_series(1, len(p))) as i from (select path, str_split(path, '/') as p from files)) group by 1)
    select a.target, r.path as resolved_file from asked a left join (select target, arg_min(idx.path, i) as path from cand join idx using (suffix) group by target) r using (target)""").replace("from sfiles)\n\n    ,", "from sfiles),"))
def suffix_files(x: Fixture) -> DataFrame:
    c = x.t("customer").filter("c_custkey % 3 = 0").join(x.t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_name").alias("target")).distinct()
    asked = c.unionByName(x.t("supplier").select(F.concat(F.lit("x/y/"), F.col("s_name")).alias("target"))).unionByName(x.t("region").select(F.concat(F.lit("none/"), F.col("r_name")).alias("target")))
    found = resolve.first_found(asked, ["target"], resolve.by_suffix(F.col("target")), resolve.suffix_index(x.files()))
    return asked.join(found, "target", "left")


@query("suffix_resolve_dirs", _with("places cfiles sfiles files", """
    , firsts as (select folder, min(path) as first from files group by folder),
    idx as (select array_to_string(p[i:], '/') as suffix, arg_min(first, folder) as first from (select folder, first, p, unnest(generate_series(1, len(p))) as i from (select folder, first, str_split(folder, '/') as p from firsts)) group by 1),
    asked as (select 'github.com/org/' || n_name as target from nation union all select r_name from region union all select 'm/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey),
    cand as (select target, i, array_to_string(p[i:], '/') as suffix from (select target, p, unnest(generate_series(1, len(p))) as i from (select target, str_split(target, '/') as p from asked)))
    select a.target, r.first as resolved_file from asked a left join (select target, arg_min(idx.first, i) as first from cand join idx using (suffix) group by target) r using (target)""").replace("from sfiles)\n\n    ,", "from sfiles),"))
def suffix_dirs(x: Fixture) -> DataFrame:
    n = x.t("nation").join(x.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = (n.select(F.concat(F.lit("github.com/org/"), F.col("n_name")).alias("target")).unionByName(x.t("region").select(F.col("r_name").alias("target")))
             .unionByName(n.select(F.concat(F.lit("m/"), F.col("r_name"), F.lit("/"), F.col("n_name")).alias("target"))))
    found = resolve.first_found(asked, ["target"], resolve.by_folder(F.col("target"), ""), resolve.folder_index(x.files(), ""))
    return asked.join(found, "target", "left")


@query("candidate_resolve", """
    with universe as (select * from (values ('src/a.ts'), ('src/a.js'), ('src/b/index.ts'), ('src/c.py'), ('src/d'), ('src/d.ts'), ('src/e/__init__.py')) t(path)),
    asked as (select * from (values ('src/a'), ('src/b'), ('src/c'), ('src/d'), ('src/e'), ('src/z')) t(base)),
    ranks as (select * from (values ('', 0), ('.ts', 1), ('.js', 3), ('.py', 5), ('/index.ts', 30), ('/__init__.py', 34)) t(tail, rank))
    select a.base, arg_min(u.path, r.rank) as resolved_file from asked a cross join ranks r left join universe u on u.path = a.base || r.tail where true group by a.base""")
def candidate_resolve(x: Fixture) -> DataFrame:
    files = x.spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.js", "src/b/index.ts", "src/c.py", "src/d", "src/d.ts", "src/e/__init__.py")], "path string")
    asked = x.spark.createDataFrame([(p,) for p in ("src/a", "src/b", "src/c", "src/d", "src/e", "src/z")], "base string")
    return asked.join(resolve.first_found(asked, ["base"], resolve.exact(F.col("base"), registry.RESOLVE_EXTENSIONS, registry.INDEX_FILES), resolve.path_index(files)), "base", "left")


@query("alias_longest_prefix", """
    with aliases as (select * from (values ('r', 'short/'), ('region/', 'src/'), ('REGION', 'x/'), ('A', 'a1/'), ('AS', 'a2/'), ('ASIA', 'a3/')) t(prefix, target))
    select n_name || '|' || r_name as id, coalesce((select arg_max(target || substr(r_name, length(prefix) + 1), length(prefix)) from aliases where starts_with(r_name, prefix)), r_name) as path
    from nation join region on n_regionkey = r_regionkey""")
def alias_prefix(x: Fixture) -> DataFrame:
    aliases = {"r": "short/", "region/": "src/", "REGION": "x/", "A": "a1/", "AS": "a2/", "ASIA": "a3/"}
    n = x.t("nation").join(x.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat_ws("|", "n_name", "r_name").alias("id"), resolve.alias_target(F.col("r_name"), aliases).alias("path"))


_IMPORT_FILES = """src/app/main.py src/app/util.py src/app/__init__.py src/app/sub/__init__.py pkg/tool.py cmd/web/main.go internal/store/a.go internal/store/b.go
    src/com/acme/Util.java src/com/acme/List.java src/lib.rs src/net/mod.rs src/net/tcp.rs src/net/udp.rs lib/model/user.dart lib/main.dart Sources/Core/core.swift app/Models/User.php app/boot.php
    lib/job.rb lib/job/run.rb include/api.h src/api.c src/web/index.ts src/web/view.tsx src/web/parts/index.tsx src/x.kt src/org/q/Thing.scala src/Acme/Core/Base.cs""".split()
# (importing file, language, source, names, kind, expected)
_IMPORTS = [
    ("src/app/main.py", "python", ".util", ["f"], None, "src/app/util.py"), ("src/app/main.py", "python", ".", ["util", "sub"], None, "src/app/util.py"),
    ("src/app/sub/__init__.py", "python", "..util", ["g"], None, "src/app/util.py"), ("src/app/main.py", "python", ".", ["nothing"], None, "src/app/__init__.py"),
    ("a.py", "python", "pkg.tool", [], None, "pkg/tool.py"), ("a.py", "python", "os", [], None, None), ("a.py", "python", "src.app", ["util"], None, "src/app/__init__.py"),
    ("cmd/web/main.go", "go", "github.com/x/y/internal/store", ["store"], None, "internal/store/a.go"), ("cmd/web/main.go", "go", "fmt", ["fmt"], None, None),
    ("M.java", "java", "com.acme.Util", ["Util"], None, "src/com/acme/Util.java"), ("M.java", "java", "java.util.List", ["List"], None, "src/com/acme/List.java"), ("M.java", "java", "com.acme", ["*"], None, "src/com/acme/List.java"),
    ("src/net/tcp.rs", "rust", "super::udp", ["udp"], None, "src/net/udp.rs"), ("src/lib.rs", "rust", "crate::net", ["net"], None, "src/net/mod.rs"), ("src/lib.rs", "rust", "crate::net::*", ["*crate::net"], None, None),
    ("src/lib.rs", "rust", "self::net", ["*x"], None, "src/net/mod.rs"), ("src/lib.rs", "rust", "std::io", ["io"], None, None), ("src/net/mod.rs", "rust", "super::lib", ["lib"], None, "src/lib.rs"),
    ("lib/main.dart", "dart", "model/user.dart", [], None, "lib/model/user.dart"), ("lib/main.dart", "dart", "dart:io", [], None, None), ("lib/main.dart", "dart", "package:shop/model/user.dart", [], None, "lib/model/user.dart"),
    ("t.swift", "swift", "Core", [], None, "Sources/Core/core.swift"), ("i.php", "php", "App\\Models\\User", ["User"], None, "app/Models/User.php"), ("app/i.php", "php", "./boot", [], None, "app/boot.php"),
    ("x.rb", "ruby", "job/run", [], "require", "lib/job/run.rb"), ("lib/job.rb", "ruby", "./job/run", [], "require_relative", "lib/job/run.rb"), ("src/api.c", "c", "api.h", [], "local", "include/api.h"),
    ("src/api.c", "c", "api.h", [], "system", None), ("src/web/view.tsx", "tsx", "./parts", ["P"], None, "src/web/parts/index.tsx"), ("src/web/view.tsx", "typescript", "@/web", [], None, "src/web/index.ts"),
    ("src/web/view.tsx", "typescript", "react", [], None, None), ("src/web/parts/index.tsx", "tsx", "../view", [], None, "src/web/view.tsx"), ("m.scala", "scala", "org.q.Thing", ["Thing"], None, "src/org/q/Thing.scala"),
    ("m.cs", "c_sharp", "Acme.Core", ["*"], None, "src/Acme/Core/Base.cs"), ("src/web/view.tsx", "typescript", "../app/util", [], None, "src/app/util.py"),
]


def _lit(v: str | None) -> str:
    return "cast(null as varchar)" if v is None else f"'{v}'"


@query("import_resolve_languages", "select * from (values " + ", ".join(f"({_lit(a)}, {_lit(b)}, {_lit(c)}, {_lit(','.join(d))}, {_lit(e)}, {_lit(f)})" for a, b, c, d, e, f in _IMPORTS) + ") t(file_path, language, source, names, kind, resolved_file)")
def import_resolve(x: Fixture) -> DataFrame:
    files = x.spark.createDataFrame([(p,) for p in _IMPORT_FILES], "path string")
    rows = x.spark.createDataFrame([r[:5] for r in _IMPORTS], "file_path string, language string, source string, names array<string>, kind string")
    return resolve.resolve_imports(rows, files, dart_package="shop").withColumn("names", F.array_join("names", ","))


# Identity (P6-P14) ---------------------------------------------------------------------------------------------------

@query("anchor_key", _with("places cfiles meths", "select 'method:' || file_path || ':' || class_name || '.' || name as anchor_key, count(*)::bigint as n from meths group by 1"))
def anchors(x: Fixture) -> DataFrame:
    return graph.method_vertices(x.methods()).groupBy("anchor_key").agg(F.count(F.lit(1)).alias("n"))


@query("signature_hash", _with("places cfiles funcs", """select 'function:' || file_path || ':' || name as anchor_key,
    'sig1:' || substr(sha1('function|' || name || '|p=' || params || '|rt=' || return_type || '|async=' || case when is_async then 'True' else 'False' end || '|exp=' || case when is_exported then 'True' else 'False' end), 1, 16) as signature_hash from funcs"""))
def signatures(x: Fixture) -> DataFrame:
    return graph.function_vertices(x.functions()).select("anchor_key", "signature_hash")


@query("signature_golden", """select * from (values ('function', 'sig1:449a8184f3e86871'), ('method', 'sig1:ca06784e32d0e031'), ('class', 'sig1:2a7e281e3e8d12fb'), ('interface', 'sig1:25055a5bbfd0881d'), ('enum', 'sig1:b17e3a0e338b75be')) t(kind, signature_hash)""")
def golden(x: Fixture) -> DataFrame:
    s, n = F.lit, F.lit(None).cast("string")
    rows = [("function", ident.function_signature(s("foo"), s("(a: int, b: str)"), s("bool"), s(False), s(True))), ("method", ident.method_signature(s("Task"), s("run"), s("(self)"), n, s(False))),
            ("class", ident.class_signature(s("C"), F.array(s("B")), F.array(s("I")))), ("interface", ident.plain_signature("interface", s("I"))), ("enum", ident.plain_signature("enum", s("E")))]
    return x.spark.range(1).select(F.explode(F.array(*(F.struct(s(k).alias("kind"), c.alias("signature_hash")) for k, c in rows))).alias("r")).select("r.*")


@query("class_signatures", _with("classes resolved", """select 'class:' || r.file_path || ':' || r.name as anchor_key, r.line,
    'sig1:' || substr(sha1('class|' || r.name || '|ext=' || r.parent_name || '|impl=' || case when c.p_partkey % 3 = 0 then 'I_' || c.p_size else '' end), 1, 16) as signature_hash
    from resolved r join classes c on c.line = r.line"""))
def class_signatures(x: Fixture) -> DataFrame:
    p = _inheritance(x).select("file_path", "name", "line", "parent_name")
    c = x.classes().drop("parents").join(p, ["file_path", "name", "line"]).withColumn("parents", F.array("parent_name"))
    return graph.class_vertices(c).select("anchor_key", "line", "signature_hash")


@query("anchor_split", _with("places cfiles meths", "select distinct 'method' as kind, file_path as file, class_name || '.' || name as qualified_name from meths"))
def anchor_split(x: Fixture) -> DataFrame:
    a = F.col("anchor_key")
    return graph.method_vertices(x.methods()).select(ident.anchor_part(a, "kind").alias("kind"), ident.anchor_part(a, "file").alias("file"), ident.anchor_part(a, "name").alias("qualified_name")).distinct()


# Diff and incremental (D1-D4, G10-G12, I4-I6, S5) --------------------------------------------------------------------

_DIFF = """, old as (select 'function:' || file_path || ':' || name as k, o_orderkey, 'sig1:' || substr(sha1('function|' || name || '|p=' || params || '|rt=' || return_type || '|async=' || case when is_async then 'True' else 'False' end || '|exp=' || case when is_exported then 'True' else 'False' end), 1, 16) as h from funcs where o_orderkey % 10 <> 0),
    new as (select 'function:' || file_path || ':' || name as k, 'sig1:' || substr(sha1('function|' || name || '|p=' || case when o_orderkey % 10 = 2 then 'changed' else params end || '|rt=' || return_type || '|async=' || case when is_async then 'True' else 'False' end || '|exp=' || case when is_exported then 'True' else 'False' end), 1, 16) as h from funcs where o_orderkey % 10 <> 1),
    d as (select case when o.k is null then 'ADDED' when n.k is null then 'DELETED' else 'CHANGED' end as change_type, coalesce(o.k, n.k) as anchor_key, o.h as old_signature, n.h as signature_hash from old o full join new n on o.k = n.k where o.h is distinct from n.h)
"""


def _tail(names: str, more: str) -> str:
    return "with " + ",\n".join(_SQL[n] for n in names.split()) + more


@query("graph_diff", _tail("places cfiles funcs", _DIFF + "select change_type, anchor_key, 'function' as kind, substr(anchor_key, 10, length(anchor_key) - 9 - position(':' in reverse(anchor_key))) as file, split_part(anchor_key, ':', 3) as qualified_name, old_signature, signature_hash from d"))
def graph_diff(x: Fixture) -> DataFrame:
    return diff.compute_diff(graph.function_vertices(x.orders_state("old")), graph.function_vertices(x.orders_state("new")))


@query("graph_diff_summary", _tail("places cfiles funcs", _DIFF + "select count(*) filter (change_type = 'ADDED')::bigint as added, count(*) filter (change_type = 'CHANGED')::bigint as changed, count(*) filter (change_type = 'DELETED')::bigint as deleted, false as first_parse from d"))
def graph_diff_summary(x: Fixture) -> DataFrame:
    return diff.summary(diff.compute_diff(graph.function_vertices(x.orders_state("old")), graph.function_vertices(x.orders_state("new"))))


@query("diff_multiset", _with("places cfiles meths", """
    , g as (select 'method:' || file_path || ':' || class_name || '.' || name as k, count(*) as n, count(*) filter (params <> 'N') as m from meths group by 1)
    select case when m = 0 then 'DELETED' else 'CHANGED' end as change_type, count(*)::bigint as n from g where m <> n group by 1""").replace("o_custkey = c_custkey)\n\n    ,", "o_custkey = c_custkey),"))
def diff_multiset(x: Fixture) -> DataFrame:
    m = graph.method_vertices(x.methods())
    return diff.compute_diff(m, m.filter("params <> 'N'")).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def _touched(x: Fixture) -> DataFrame:
    return x.supplier_files().filter("s_suppkey % 5 = 0").select("path")


@query("incoming_edges_capture", _with("places cfiles sfiles imps", "select 'IMPORTS' as type, src as src_file, cast(null as varchar) as src_name, dst as dst_file, cast(null as varchar) as dst_name from imps join sfiles on path = dst where s_suppkey % 5 = 0"))
def capture(x: Fixture) -> DataFrame:
    return graph.capture_incoming(graph.imports(x.files(), x.imports()), _touched(x))


@query("edge_restore_counts", _with("places cfiles sfiles imps", """select count(*) filter (s_suppkey % 10 <> 0)::bigint as restored, count(*) filter (s_suppkey % 10 = 0)::bigint as dropped
    from imps join sfiles s on s.path = dst join cfiles c on c.path = src where s_suppkey % 5 = 0 and c_custkey % 7 <> 0"""))
def restore_counts(x: Fixture) -> DataFrame:
    files = x.customer_files().select("path").unionByName(x.supplier_files().filter("s_suppkey % 10 <> 0").select("path"))
    empty = x.spark.createDataFrame([], "file_path string, name string, line int")
    _, n = graph.restore_edges(capture(x), {"File": files, "Class": empty, "Interface": empty}, x.customer_files().filter("c_custkey % 7 = 0").select("path"))
    return n


@query("touched_set", _with("places cfiles", "select path from cfiles where (c_custkey % 3 = 0 and c_custkey % 2 = 0) or c_custkey % 11 = 0"))
def touched_set(x: Fixture) -> DataFrame:
    c = x.customer_files()
    changed, parsed, removed = (c.filter(f"c_custkey % {k} = 0").select("path") for k in (3, 2, 11))
    return incremental.touched_files(changed, parsed, removed)


@query("incremental_rewrite", _with("places cfiles funcs", """select 'function:' || file_path || ':' || name as anchor_key, params from funcs join cfiles on path = file_path where c_custkey % 4 <> 0
    union all select 'function:' || file_path || ':' || name, 'fresh' from funcs join cfiles on path = file_path where c_custkey % 4 = 0 and o_orderkey % 2 = 0"""))
def incremental_rewrite(x: Fixture) -> DataFrame:
    touched = x.customer_files().filter("c_custkey % 4 = 0").select("path")
    old = graph.function_vertices(x.functions())
    none = {t: old.limit(0) for t in graph.ELEMENTS}
    kept = graph.delete_files({**none, "Function": old, "File": graph.file_vertices(x.files()), "edges": graph.imports(x.files(), x.imports())}, touched)["Function"]
    fresh = graph.function_vertices(x.functions().filter("o_orderkey % 2 = 0").withColumn("params", F.lit("fresh"))).join(touched, F.col("file_path") == F.col("path"), "left_semi")
    return kept.unionByName(fresh).select("anchor_key", "params")


@query("delete_files", _with("places cfiles sfiles files dirs imps", """select 'File' as type, (select count(*) from files) - (select count(*) from sfiles where s_suppkey % 5 = 0) as n
    union all select 'IMPORTS', count(*) from imps join sfiles on path = dst where s_suppkey % 5 <> 0 union all select 'Directory', count(*) from dirs"""))
def delete_files(x: Fixture) -> DataFrame:
    files = graph.file_vertices(x.files())
    none = x.spark.createDataFrame([], "file_path string")
    left = graph.delete_files({"Directory": graph.directories(files), "File": files, **dict.fromkeys(graph.ELEMENTS, none), "edges": graph.imports(files, x.imports())}, _touched(x))
    return graph.union([left[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("type"), "n") for t, name in (("File", "File"), ("edges", "IMPORTS"), ("Directory", "Directory"))])


# Traversal (T6, T11) -------------------------------------------------------------------------------------------------

@query("traverse_1hop", _with("places cfiles sfiles imps", "select src as path, count(*)::bigint as n from imps group by 1"))
def traverse_1hop(x: Fixture) -> DataFrame:
    start = x.supplier_files().select(F.col("path").alias("v"))
    return traverse.step(start, graph.imports(x.files(), x.imports()), "in").groupBy(F.col("v").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("traverse_khop", _with("places cfiles sfiles imps", """
    , h0 as (select path as v from cfiles where starts_with(path, 'AFRICA/')), h1 as (select distinct dst as v from imps join h0 on src = v),
    h2 as (select distinct src as v from imps join h1 on dst = v where src not in (select v from h0)) select hop::integer as hop, count(*)::bigint as n from
    (select 0 as hop from h0 union all select 1 from h1 union all select 2 from h2) group by hop""").replace("l_suppkey = s_suppkey)\n\n    ,", "l_suppkey = s_suppkey),"))
def traverse_khop(x: Fixture) -> DataFrame:
    start = x.customer_files().filter("startswith(path, 'AFRICA/')").select(F.col("path").alias("v"))
    return traverse.khop(start, settle(graph.imports(x.files(), x.imports()), "edges"), 2, "both", settle).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


@query("containment_closure", _with("places cfiles sfiles files", "select folder as ancestor, count(*)::bigint as n from files group by 1 union all select split_part(folder, '/', 1), count(*) from files group by 1"))
def containment_closure(x: Fixture) -> DataFrame:
    return traverse.containment(x.files(), paths.ancestors).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query("inherits_transitive", _with("classes resolved", """
    , e as (select distinct 'Class' || chr(9) || r.file_path || chr(9) || r.name || chr(9) || r.line as src, 'Class' || chr(9) || t.file_path || chr(9) || t.name || chr(9) || t.line as dst
      from resolved r join classes t on t.file_path = r.parent_file and t.name = r.parent_name where r.confidence <> 'unresolved'),
    tops as (select 'Class' || chr(9) || file_path || chr(9) || name || chr(9) || line as v from classes except select src from e),
    z as (with recursive w as (select v from tops union select e.src from e join w on e.dst = w.v) select v from w)
    select v from z""").replace("and h.rn = 1)\n\n    ,", "and h.rn = 1),"))
def inherits_transitive(x: Fixture) -> DataFrame:
    classes, v = x.classes(), graph.element_key("Class", F.col("file_path"), F.col("name"), F.col("line"))
    heirs, bearers = graph.inherits_by_name(classes, _inheritance(x))
    # by way of the name that heirs ask for: two short edges instead of one for every heir and every bearer of the name
    name = F.concat_ws("\t", F.lit("Name"), "parent_file", "parent_name").alias("name")
    heirs, bearers = settle(heirs.select("src", name), "heirs"), settle(bearers.select(name, "dst"), "bearers")
    heirs = heirs.join(bearers.select("name").distinct().hint("merge"), "name", "left_semi")
    edges = settle(heirs.select("src", F.col("name").alias("dst")).unionByName(bearers.select(F.col("name").alias("src"), "dst")), "edges")
    tops = classes.select(v.alias("v")).join(heirs.select(F.col("src").alias("v")).hint("merge"), "v", "left_anti")  # classes that inherit from none that is known
    return traverse.closure(tops, edges, settle, "in", 2000).filter("v like 'Class\t%'").select("v")


# Links (R22) ---------------------------------------------------------------------------------------------------------

def _links(x: Fixture) -> DataFrame:
    """Imports of a flat tree of nation files: every nation imports the next key's by a relative path, and one that is missing."""
    n = x.t("nation").select("n_nationkey", F.concat(F.lit("src/"), F.col("n_name"), F.lit(".ts")).alias("file_path"))
    k = F.col("n_nationkey")
    target = x.t("nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("n2"))
    rows = n.join(target, (k + 1) % 25 == F.col("k2"))
    return rows.select("file_path", F.when(k % 5 == 4, F.concat(F.lit("lib/"), F.col("n2"))).otherwise(F.concat(F.lit("./"), F.col("n2"))).alias("source"),
                       F.when(k % 4 == 0, F.array(F.lit("missing"))).otherwise(F.array(F.lit("thing"))).alias("names"), k.alias("line"))


def _link_files(x: Fixture) -> DataFrame:
    return x.t("nation").select(F.concat(F.lit("src/"), F.col("n_name"), F.lit(".ts")).alias("path"))


def _link_symbols(x: Fixture) -> DataFrame:
    return _link_files(x).select(F.lit("thing").alias("name"), F.lit("function").alias("kind"), F.col("path").alias("defined_in"), F.lit(1).alias("line"))


_LINK = "with l as (select 'src/' || a.n_name || '.ts' as file_path, 'src/' || b.n_name || '.ts' as target, b.n_name as n2, a.n_nationkey as k from nation a join nation b on (a.n_nationkey + 1) % 25 = b.n_nationkey) "


@query("linked_symbols", _LINK + "select file_path as from_file, target as to_file, 'thing' as symbol_name, k as line from l where k % 5 <> 4 and k % 4 <> 0")
def linked_symbols(x: Fixture) -> DataFrame:
    return linker.link(_links(x), _link_files(x), _link_symbols(x))[0]


@query("unresolved_imports", _LINK + "select file_path as file, 'missing' as symbol, './' || n2 as source, k as line from l where k % 5 <> 4 and k % 4 = 0")
def unresolved_imports(x: Fixture) -> DataFrame:
    return linker.link(_links(x), _link_files(x), _link_symbols(x))[1]


@query("dependents", _LINK + "select file_path as path from l where k % 5 <> 4 and target = 'src/NATION_3.ts'")
def dependents(x: Fixture) -> DataFrame:
    return linker.dependents(linker.link_targets(_links(x), _link_files(x)), "src/NATION_3.ts")


@query("dependencies", _LINK + "select target as path from l where k % 5 <> 4 and file_path = 'src/NATION_3.ts'")
def dependencies(x: Fixture) -> DataFrame:
    return linker.dependencies(linker.link_targets(_links(x), _link_files(x)), "src/NATION_3.ts")


# Text fields (P9-P11, P13, P15, P16) ---------------------------------------------------------------------------------

def _quote(v) -> str:
    return "cast(null as varchar)" if v is None else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _quote(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) t({names})"


_FIELDS = [("(self,\n   x: int)", ": -> bool", "List<Map<K, V>>", "**Store", "a b/ç", "pkg.mod.Name"), ("  ", "->  str", "Plain", "T", "", "Name"), ("(" + "x" * 400 + ")", "void", "A<B>", "*", "ok-1.x_y", "a."), (None, None, None, None, None, None)]
_FIELDS_OUT = [("(self, x: int)", "bool", "List", "Store", "a_b__", "Name"), (None, "str", "Plain", "T", "default", "Name"), ("(" + "x" * 299, "void", "A", "", "ok-1.x_y", ""), (None,) * 6]


@query("text_fields", _values(_FIELDS_OUT, "params, return_type, base, receiver, database, simple"))
def text_fields(x: Fixture) -> DataFrame:
    c = F.col
    return x.spark.createDataFrame(_FIELDS, "p string, r string, g string, t string, d string, n string").select(
        ident.params_text(c("p")).alias("params"), ident.return_text(c("r")).alias("return_type"), ident.without_generics(c("g")).alias("base"), ident.without_pointer(c("t")).alias("receiver"),
        paths.database_name(c("d")).alias("database"), paths.simple_name(c("n")).alias("simple"))


_SCRIPTS = [("vue", "<template>\n<p/>\n</template>\n<script setup>\nlet a\n</script>\n<style>", "\n\n\n\nlet a\n\n"), ("svelte", "<script>\nlet b\n</script>\n<p/>", "\nlet b\n\n"), ("astro", "---\nlet c\n---\n<p/>\n<script>\nlet d\n</script>", "\nlet c\n\n\n\nlet d\n"),
            ("vue", "", ""), ("astro", "<p/>", "")]


@query("script_blank", _values([(m, len(t), o.replace("\n", "|")) for m, t, o in _SCRIPTS], "mode, n, script"))
def script_blank(x: Fixture) -> DataFrame:
    from codeweave.functions.source_text import script_only

    def run(frames):
        for f in frames:
            yield f.assign(script=[script_only(t, m).replace("\n", "|") for t, m in zip(f["content"], f["mode"])])[["mode", "n", "script"]]
    return x.spark.createDataFrame([(m, t, len(t)) for m, t, _ in _SCRIPTS], "mode string, content string, n int").mapInPandas(run, "mode string, n int, script string")


# Discovery and parse mode (S2, F1-F15) -------------------------------------------------------------------------------

_LISTED = [("src/a.py", 10, "take"), ("node_modules/a.js", 10, "folder"), ("other/a.py", 10, "outside"), ("src/skip/a.py", 10, "excluded"), ("src/yarn.lock", 10, "lock"), ("src/a.min.js", 10, "generated"), ("src/keep.min.js", 10, "take"), ("src/.x", 10, "hidden"),
           ("src/a.png", 10, "extension"), ("src/b.py", 3_000_000, "oversize"), ("src/c.py", 0, "empty"), ("src/d.weird", 10, "unknown"), ("src/keep.weird", 10, "take"), ("src/skip/keep.weird", 10, "excluded"), ("src/.git/a.py", 10, "folder")]


@query("discovery_verdicts", _values([(p, v) for p, _, v in _LISTED], "path, verdict"))
def discovery(x: Fixture) -> DataFrame:
    from codeweave.sources import tree

    rows = x.spark.createDataFrame([(p, b, i) for i, (p, b, _) in enumerate(_LISTED)], "path string, bytes long, parse_order long")
    return tree.candidates(rows, tree.Discovery(include=["*keep*"], exclude=["src/skip/*"], folder="src")).select("path", "verdict")


_MODES = [("python", 10, 5, "full"), ("css", 10, 5, "passthrough"), ("lua", 10, 5, "passthrough"), ("javascript", 60_000, 50, "passthrough"), ("javascript", 60_000, 0, "full"), ("java", 90_000, 40_001, "passthrough"), ("go", 2_000_100, 5000, "passthrough"), ("go", 20_000, 50, "full")]


@query("parse_modes", _values([(i, m) for i, (_, _, _, m) in enumerate(_MODES)], "id, mode"))
def parse_modes(x: Fixture) -> DataFrame:
    from codeweave.sources import tree

    rows = x.spark.createDataFrame([(i, lang, n, k) for i, (lang, n, k, _) in enumerate(_MODES)], "id int, language string, n int, k int")
    text = F.concat(F.repeat(F.lit("\n"), F.col("k")), F.repeat(F.lit("x"), F.col("n") - F.col("k")))
    return tree.parse_mode(rows.withColumn("content", text)).select("id", "mode")


# Extraction (X1-X12, M1-M14) -----------------------------------------------------------------------------------------

def _parsed(x: Fixture) -> DataFrame:
    from codeweave.operators import extract
    from codeweave.plans.samples import SAMPLES

    rows = [(f"sample.{lang}", lang, i, text, "full") for i, (lang, (text, _)) in enumerate(SAMPLES.items())]
    return extract.extract(x.spark.createDataFrame(rows, "path string, language string, parse_order long, content string, mode string").repartition(4))


def _expected_elements() -> list[tuple]:
    from codeweave.plans.samples import SAMPLES

    out = []
    for lang, (_, want) in SAMPLES.items():
        out += [(lang, "function", n, None, str(e).lower()) for n, e in want.get("functions", [])] + [(lang, "method", n, c, None) for c, n in want.get("methods", [])]
        out += [(lang, "class", n, ",".join(p), ",".join(i)) for n, p, i in want.get("classes", [])] + [(lang, k[:-1], n, None, None) for k in ("interfaces", "enums") for n in want.get(k, [])]
    return out


@query("extract_elements", _values(_expected_elements(), "language, kind, name, owner, detail"))
def extract_elements(x: Fixture) -> DataFrame:
    p = _parsed(x)
    each = lambda k: p.select("language", F.explode(k).alias("e"))
    none = F.lit(None).cast("string")
    shape = lambda df, kind, owner, detail: df.select("language", F.lit(kind).alias("kind"), F.col("e.name").alias("name"), owner.alias("owner"), detail.alias("detail"))
    return graph.union([
        shape(each("functions"), "function", none, F.col("e.is_exported").cast("string")), shape(each("methods"), "method", F.col("e.class_name"), none),
        shape(each("classes"), "class", F.array_join("e.parents", ","), F.array_join("e.implements", ",")), shape(each("interfaces"), "interface", none, none), shape(each("enums"), "enum", none, none)])


def _expected_imports() -> list[tuple]:
    from codeweave.plans.samples import SAMPLES

    return [(lang, s, ",".join(n)) for lang, (_, want) in SAMPLES.items() for s, n in want.get("imports", [])]


@query("extract_imports", _values(_expected_imports(), "language, source, names"))
def extract_imports(x: Fixture) -> DataFrame:
    return _parsed(x).select("language", F.explode("imports").alias("e")).select("language", "e.source", F.array_join("e.names", ",").alias("names"))


# Query front-ends (Q2, Q4, T1-T7, T10) -------------------------------------------------------------------------------

@query("cypher_match", _with("classes resolved", """select s.file_path as file, count(*)::bigint as n from resolved r join classes s on s.file_path = r.file_path and s.name = r.name and s.line = r.line
    join classes t on t.file_path = r.parent_file and t.name = r.parent_name where r.confidence <> 'unresolved' and t.name like 'U%' group by 1"""))
def cypher_match(x: Fixture) -> DataFrame:
    from codeweave.query import cypher, sql

    t = _rebuilt(x)
    return cypher.query(sql.vertices(t), t["edges"], "MATCH (a:Class)-[:INHERITS]->(b:Class) WHERE b.name STARTS WITH $p RETURN a.file_path AS file, count(*) AS n", {"p": "U"})


@query("gremlin_out", _with("places cfiles sfiles files", "select split_part(folder, '/', 2) as key, count(*)::bigint as value from files group by 1"))
def gremlin_out(x: Fixture) -> DataFrame:
    from codeweave.query import gremlin, sql

    files = x.files()
    t = {"Directory": graph.directories(files), "File": graph.file_vertices(files)}
    edges = graph.contains_directories(t["Directory"]).unionByName(graph.contains_files(t["File"]))
    return gremlin.query(sql.vertices(t), edges, "g.V().hasLabel('File').in('CONTAINS').groupCount().by('name')")


@query("sql_passthrough", _with("places cfiles sfiles files", "select split_part(path, '/', 1) as domain, count(*)::bigint as n from files where split_part(path, '/', 1) in ('REGION_0', 'REGION_1', 'ASIA', 'AFRICA') group by 1"))
def sql_passthrough(x: Fixture) -> DataFrame:
    from codeweave.query import sql

    graph.file_vertices(x.files()).createOrReplaceTempView("File")
    return sql.query(x.spark, "SELECT domain, count(*) AS n FROM File WHERE domain IN ['REGION_0', 'REGION_1', 'ASIA', :r] GROUP BY domain", {"r": "AFRICA"})


@query("grouping_sets", "select o_orderstatus as status, o_orderpriority as priority, count(*)::bigint as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(x: Fixture) -> DataFrame:
    from codeweave.query import sql

    x.t("orders").createOrReplaceTempView("orders")
    return sql.query(x.spark, "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")


@query("window_ranks", "select * from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::integer as rank from events) where rank <= 3")
def window_ranks(x: Fixture) -> DataFrame:
    from codeweave.query import sql

    x.t("events").createOrReplaceTempView("events")
    return sql.query(x.spark, "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3")


@query("manifest_changes", """with o as (select doc_id, sha1(text) as h from documents where doc_id % 7 <> 0), n as (select doc_id, sha1(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 0)
    select coalesce(o.doc_id, n.doc_id)::varchar as path, case when n.h is null then 'removed' else 'changed' end as change from o full join n on o.doc_id = n.doc_id where o.h is distinct from n.h""")
def manifest_changes(x: Fixture) -> DataFrame:
    from codeweave.operators.incremental import changes_by_content

    d = x.t("documents").withColumn("path", F.col("doc_id").cast("string"))
    h = lambda c: F.sha1(c.cast("binary")).alias("content_hash")
    old = d.filter("doc_id % 7 <> 0").select("path", h(F.col("text")))
    new = d.filter("doc_id % 11 <> 0").select("path", h(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return changes_by_content(old, new)
