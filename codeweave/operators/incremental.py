"""Full and incremental parses of a source tree into a stored graph."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import diff, extract, graph, resolve
from codeweave.sources import repository, tree
from codeweave.sources.store import GraphStore, scratch, settle


FILES_A_TASK = 200


def _paths(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "path string")


def touched_files(changed: DataFrame, parsed_ok: DataFrame, removed: DataFrame) -> DataFrame:
    """Files whose part of the graph is rewritten: changed ones that were parsed, and removed ones. Failed ones keep what they have."""
    return changed.select("path").intersect(parsed_ok.select("path")).union(removed.select("path")).distinct()


def changes_by_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (changed or removed) between two manifests ``path, content_hash``; for trees without version control."""
    a, b = old.select("path", F.col("content_hash").alias("before")), new.select("path", F.col("content_hash").alias("after"))
    both = a.join(b, "path", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("path", F.when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"))


def resolved_records(parsed: DataFrame, universe: DataFrame, aliases: dict[str, str], dart_package: str | None, extra_symbols: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records of parsed files with imports and parents resolved against all discovered files and, if given, stored symbols."""
    rec = extract.records(parsed)
    rec["imports"] = resolve.resolve_imports(rec["imports"], universe, aliases, dart_package)
    per_file = 1_000_000
    symbols = rec["classes"].filter("name is not null").select("name", "file_path", "line", (F.col("parse_order") * per_file + F.col("pos")).alias("parse_order"))
    if extra_symbols is not None:
        stored = extra_symbols.withColumn("parse_order", F.lit(0).cast("long"))
        symbols = resolve.merge_symbols(symbols, stored, parsed.select("path"))
    wanted = rec["classes"].select("file_path", "name", "line", F.posexplode("parents").alias("pos", "parent")).filter("parent <> ''")
    named = rec["imports"].select("file_path", "resolved_file", F.col("pos").alias("imp_order"), F.explode("names").alias("imported"))
    parents = settle(resolve.resolve_inheritance(wanted, symbols, named), "parents")
    names = parents.groupBy("file_path", "name", "line").agg(F.collect_list("parent_name").alias("resolved"))
    rec["classes"] = rec["classes"].drop("parents").join(names, ["file_path", "name", "line"], "left").withColumnRenamed("resolved", "parents").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    rec["parents"] = parents
    return rec


def parse(spark: SparkSession, store: GraphStore, repo: str, project: str | None = None, clean: bool = True, incremental: bool = False, changed_files: list[str] | None = None,
          removed_files: list[str] | None = None, config: tree.Discovery | None = None, trigger: str = "manual", alias_mode: str = "tree", progress: Callable[[str], None] | None = None, token: str | None = None,
          ship: bool | None = None) -> dict:
    """Parse ``repo`` (a folder or an address) into the graph of ``project``.

    Incremental parses take the given changes or derive them from the stored commit; without a known base they fall back to a
    full parse. Unchanged files' outgoing edges are not looked at again. The diff is reported and logged, and never fails a
    parse. ``ship`` sends contents through the shared folder instead of opening them in the tasks; by default where a cluster parses a copy.
    ``incremental`` with an explicit ``clean`` of an existing graph is a contradiction and is refused by ``clean=True, incremental=True``.
    """
    if incremental and clean:
        raise ValueError("an incremental parse keeps the graph: pass clean=False")
    project = project or os.path.basename(repo.rstrip("/")).removesuffix(".git")
    say = progress or (lambda _: None)
    local = os.path.isdir(repo)
    with store.lock(project):
        root = repo if local else repository.clone(repo, token)
        if root is None:
            return {"status": "failed", "project": project, "error": "could not fetch the repository"}
        try:
            # a copy lies in the driver's own folder, which executors of a cluster don't see
            shipped = not local and not spark.sparkContext.master.startswith("local") if ship is None else ship
            return _parse(spark, store, repo, root, project, incremental, changed_files, removed_files, config, trigger, alias_mode, say, shipped)
        finally:
            if not local:
                shutil.rmtree(root, ignore_errors=True)


def _parse(spark, store, repo, root, project, incremental, changed_files, removed_files, config, trigger, alias_mode, say, shipped) -> dict:
    head, now = repository.head_sha(root), dt.datetime.now(dt.timezone.utc).isoformat()
    had = store.version(project) is not None
    changed = removed = None
    if incremental and had:
        if changed_files is not None or removed_files is not None:
            changed, removed = changed_files or [], removed_files or []
        else:
            derived = repository.changes(root, store.origin_sha(project) or "", head)
            if derived is not None:
                changed, removed = derived
        incremental = changed is not None
        if incremental and not changed and not removed:
            store.touch_origin(project, repo, head, now)
            return {"status": "completed", "project": project, "incremental": True, "no_changes": True}
    else:
        incremental = False
    say("discover")
    try:
        files, oversize = tree.discover(spark, root, config)
    except tree.TooManyFiles as e:
        return {"status": "failed", "project": project, "error": str(e)}
    files = settle(files, "files")
    say("parse")
    wanted = files.join(F.broadcast(_paths(spark, changed)), "path", "left_semi") if incremental else files  # a commit's list, held by the driver already
    # the listing is small and would sit in few partitions; parsing is the work, so it is dealt out by path
    tasks = max(spark.sparkContext.defaultParallelism, wanted.count() // FILES_A_TASK)
    contents = tree.ship(wanted, root, f"{scratch(spark)}/codeweave/contents-{uuid.uuid4().hex}") if shipped else None
    parsed = settle(extract.extract(tree.parse_mode(tree.read_files(wanted.repartition(tasks, "path"), root, contents), config)), "parsed")
    ok = parsed.filter("mode <> 'failed'")
    failed = [r["path"] for r in parsed.filter("mode = 'failed'").select("path").collect()] if incremental else []
    symbols = store.class_symbols(project, ok.select("path")) if incremental else None
    say("resolve")
    rec = resolved_records(ok, files.select("path"), repository.aliases(root, alias_mode), repository.dart_package(root), symbols)
    stored = store.tables(project) if had else None
    say("write")
    if incremental:
        touched = settle(touched_files(_paths(spark, changed), ok, _paths(spark, removed)), "touched")
        before = store.element_rows(project, touched)
        captured = settle(graph.capture_incoming(stored["edges"], touched), "captured")
        left = graph.delete_files(stored, touched)
        # fresh vertices first: edges of the new part may end in the kept part
        fresh = graph.build(rec)
        tables = {t: left[t].unionByName(fresh[t]) for t in ["File", *graph.ELEMENTS]}
        tables["Directory"] = left["Directory"].unionByName(fresh["Directory"]).distinct()
        new_edges = graph.union([
            fresh["edges"].filter("etype = 'CONTAINS'"), graph.imports(tables["File"], rec["imports"]), graph.inherits(tables["Class"], rec["parents"]), graph.implements(rec["classes"], tables["Interface"])])
        again, restored = graph.restore_edges(captured, tables, ok.select("path"))
        tables["edges"] = left["edges"].unionByName(new_edges).unionByName(again).dropDuplicates()
        tables["Origin"] = stored["Origin"]
        after = graph.union([fresh[t].select("anchor_key", "signature_hash") for t in graph.ELEMENTS])
        edge_report = restored.first().asDict()
    else:
        tables = graph.build(rec)
        before = store.element_rows(project) if had else spark.createDataFrame([], "anchor_key string, signature_hash string")
        after = graph.union([tables[t].select("anchor_key", "signature_hash") for t in graph.ELEMENTS])
        edge_report = {}
    before, after = settle(before, "before"), settle(after, "after")
    n = files.count()
    tables["Origin"] = spark.createDataFrame([("origin", repo, head, now, n)], graph.SCHEMAS["Origin"])
    try:
        version = store.write(project, tables)
    except Exception:
        store.clear_origin_sha(project)
        raise
    delta = settle(diff.compute_diff(before, after), "diff")
    first = not had
    report = diff.summary(delta, first).first().asDict()
    out = {"status": "completed", "project": project, "version": version, "incremental": incremental, "diff": report, "skipped_oversize": [r.asDict() for r in oversize.collect()],
           "counts": {r["type"]: r["n"] for r in graph.counts(store.tables(project)).collect()}, **({"edges": edge_report} if edge_report else {})}
    if not first and any(report[k] for k in ("added", "changed", "deleted")):
        out["entries"] = [r.asDict() for r in diff.entries(delta, 200).collect()]
        store.append_diff(project, trigger, delta, report)
    # a changed file that failed keeps the old base, so that the next parse takes it up again
    store.touch_origin(project, repo, (store.origin_sha(project) or "") if failed else head, now, n)
    return out
