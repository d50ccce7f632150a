"""Versioned snapshots of project graphs, the project catalog, provenance and the diff log.

Layout under a root folder that executors share: ``<project>/v=<n>/<table>`` as Parquet, an empty file ``<project>/_CURRENT.<n>`` for each finished
version, the greatest of which readers see, ``_difflog`` as one append-only table beside the projects. A snapshot is written whole and then made current by
adding its file; nothing is replaced, so there is no moment without a current version, readers never see half a rewrite, and a failed write changes nothing. Small
files go through Hadoop's FileSystem, so any store that Spark reads will do. A lock names the time it was taken; one that is older than LOCK_HOURS was left by a
job that died, and is taken over.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import graph


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session has it; one of our own only where it is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/codeweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LOCK_HOURS = 12


class Busy(RuntimeError):
    """Another job holds the project."""


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # small files ----------------------------------------------------------------------------------------------------

    def _read(self, path: str) -> str | None:
        if not self.fs.exists(self._path(path)):
            return None
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str, new_only: bool = False) -> None:
        out = self.fs.create(self._path(path), not new_only)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _list(self, path: str, folders: bool = True) -> list[str]:
        if not self.fs.exists(self._path(path)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path)) if s.isDirectory() == folders]

    # catalog --------------------------------------------------------------------------------------------------------

    @staticmethod
    def name_of(project: str) -> str:
        """Characters outside ``[A-Za-z0-9_.-]`` become ``_``; at most 64; never empty."""
        return "".join(c if c.isascii() and (c.isalnum() or c in "_.-") else "_" for c in project)[:64] or "default"

    def projects(self) -> list[str]:
        return sorted(p for p in self._list(self.root) if not p.startswith("_") and self.version(p) is not None)

    def drop(self, project: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{self.name_of(project)}"), True)

    def version(self, project: str) -> int | None:
        marks = [n.rpartition(".")[2] for n in self._list(f"{self.root}/{self.name_of(project)}", False) if n.startswith("_CURRENT.")]
        return max((int(n) for n in marks if n.isdecimal()), default=None)

    # snapshots ------------------------------------------------------------------------------------------------------

    def write(self, project: str, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version and make it current; returns the version."""
        name = self.name_of(project)
        taken = [int(v[2:]) for v in self._list(f"{self.root}/{name}") if v.startswith("v=")]
        n = max([self.version(project) or 0, *taken]) + 1
        base = f"{self.root}/{name}/v={n}"
        for table in [*graph.VERTEX_TYPES, "edges"]:
            df = tables.get(table)
            if df is None:
                df = self.spark.createDataFrame([], graph.SCHEMAS[table])
            (df.write.partitionBy("etype") if table == "edges" else df.write).parquet(f"{base}/{table}")
        self._write(f"{self.root}/{name}/_CURRENT.{n}", "")
        return n

    def read(self, project: str, table: str, version: int | None = None) -> DataFrame:
        n = version or self.version(project)
        if n is None:
            raise KeyError(f"no such project: {project}")
        return self.spark.read.schema(graph.SCHEMAS[table]).parquet(f"{self.root}/{self.name_of(project)}/v={n}/{table}")

    def tables(self, project: str) -> dict[str, DataFrame]:
        return {t: self.read(project, t) for t in [*graph.VERTEX_TYPES, "edges"]}

    def vacuum(self, project: str, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions."""
        now = self.version(project) or 0
        for v in self._list(f"{self.root}/{self.name_of(project)}"):
            if v.startswith("v=") and int(v[2:]) <= now - keep:
                self.fs.delete(self._path(f"{self.root}/{self.name_of(project)}/_CURRENT.{v[2:]}"), False)
                self.fs.delete(self._path(f"{self.root}/{self.name_of(project)}/{v}"), True)

    # reads that an incremental parse needs ----------------------------------------------------------------------------

    def element_rows(self, project: str, files: DataFrame | None = None) -> DataFrame:
        """``anchor_key, signature_hash`` of all elements, or of those in ``files(path)``; an empty list of files means none."""
        rows = graph.union([self.read(project, t).select("file_path", "anchor_key", "signature_hash") for t in graph.ELEMENTS]).filter("anchor_key is not null")
        if files is not None:
            rows = rows.join(files.select("path"), F.col("file_path") == F.col("path"), "left_semi")
        return rows.select("anchor_key", "signature_hash")

    def class_symbols(self, project: str, exclude: DataFrame) -> DataFrame:
        """``name, file_path, line`` of stored classes outside ``exclude(path)``; fails loudly where they can't be read."""
        c = self.read(project, "Class")
        return c.join(exclude.select("path"), c["file_path"] == F.col("path"), "left_anti").select("name", "file_path", F.coalesce("line", F.lit(0)).alias("line"))

    # provenance -------------------------------------------------------------------------------------------------------

    def origin(self, project: str) -> dict | None:
        text = self._read(f"{self.root}/{self.name_of(project)}/_ORIGIN")
        return json.loads(text) if text else None

    def touch_origin(self, project: str, repo: str, commit_sha: str, parsed_at: str, files: int | None = None) -> None:
        """Replace the origin row; the file count stays where it is not given."""
        old = self.origin(project) or {}
        row = {"id": "origin", "repo": repo, "commit_sha": commit_sha, "parsed_at": parsed_at, "files": old.get("files") if files is None else files}
        self._write(f"{self.root}/{self.name_of(project)}/_ORIGIN", json.dumps(row))

    def origin_sha(self, project: str) -> str | None:
        return (self.origin(project) or {}).get("commit_sha") or None

    def clear_origin_sha(self, project: str) -> None:
        """After a failed write: the next parse has no base and rebuilds."""
        if old := self.origin(project):
            self._write(f"{self.root}/{self.name_of(project)}/_ORIGIN", json.dumps(old | {"commit_sha": ""}))

    # diff log ---------------------------------------------------------------------------------------------------------

    def append_diff(self, project: str, cause: str, diff: DataFrame, summary: dict, each: int = 500) -> None:
        """One row: the summary and up to ``each`` entries of every kind of change (what the log shows, not what is computed)."""
        from codeweave.operators.diff import entries

        shown = [r.asDict() for r in entries(diff, each).collect()]
        if any(summary.get(k, 0) > each for k in ("added", "changed", "deleted")):
            summary = summary | {"entries_truncated": True}
        ts = dt.datetime.now(dt.timezone.utc).isoformat()
        row = [(self.name_of(project), ts, cause, json.dumps(summary), json.dumps(shown))]
        self.spark.createDataFrame(row, graph.SCHEMAS["DiffLog"]).write.mode("append").parquet(f"{self.root}/_difflog")

    def diff_log(self, project: str, limit: int = 50) -> DataFrame:
        if not self.fs.exists(self._path(f"{self.root}/_difflog")):
            return self.spark.createDataFrame([], graph.SCHEMAS["DiffLog"])
        return self.spark.read.schema(graph.SCHEMAS["DiffLog"]).parquet(f"{self.root}/_difflog").filter(F.col("project") == self.name_of(project)).orderBy(F.desc("ts")).limit(limit)

    # one job a project ------------------------------------------------------------------------------------------------

    def lock(self, project: str):
        """Context manager; raises :class:`Busy` while another job holds the project."""
        store, path = self, f"{self.root}/{self.name_of(project)}/_LOCK"

        class Held:
            def __enter__(self):
                from py4j.protocol import Py4JJavaError

                held = store._read(path)
                if held is not None and (not held or time.time() - float(held) > LOCK_HOURS * 3600):
                    store.fs.delete(store._path(path), False)
                try:
                    store._write(path, str(time.time()), new_only=True)
                except Py4JJavaError as e:
                    raise Busy(f"{project} is being parsed") from e

            def __exit__(self, *exc):
                store.fs.delete(store._path(path), False)

        return Held()
