"""Source trees as tables: listing with the discovery rules, and reading on the executors.

Spark's own file sources hide names that begin with ``_`` or ``.``, so the tree is walked on the driver, where only paths and
sizes are held; contents are opened by the tasks (``mapInPandas``), or, where executors do not see the tree (a copy in the driver's own folder), shipped
from the driver through the shared folder, a batch of at most SHIP_BYTES a time (:func:`ship`).
"""

from __future__ import annotations

import fnmatch
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.functions import paths, registry


@dataclass
class Discovery:
    """Options of a listing: ``include`` forces files in, ``exclude`` wins over it; patterns match whole relative paths.

    Files above ``max_file_size`` are not taken; of those above ``max_chars`` or ``max_lines`` only the file itself is, without elements. :meth:`whole` takes all of all.
    """

    max_file_size: int = registry.MAX_FILE_BYTES
    max_chars: int = registry.MAX_CHARS
    max_lines: int = registry.MAX_LINES
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    folder: str = ""
    max_files: int = int(os.environ.get("MAX_FILES", registry.MAX_FILES))

    @classmethod
    def whole(cls, **options) -> Discovery:
        """Without limits on the size of a file."""
        return cls(max_file_size=sys.maxsize, max_chars=sys.maxsize, max_lines=sys.maxsize, **options)


class TooManyFiles(RuntimeError):
    pass


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, bytes, order): files of a folder before its subfolders, each in order of name; blocked folders are not entered."""
    order = 0
    for here, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in registry.BLOCKED_FOLDERS and not d.startswith("."))
        for name in sorted(names):
            full = os.path.join(here, name)
            try:
                size = os.path.getsize(full)
            except OSError:
                continue
            yield os.path.relpath(full, root).replace(os.sep, "/"), size, order
            order += 1


def candidates(files: DataFrame, config: Discovery | None = None) -> DataFrame:
    """``files(path, bytes, parse_order)`` with ``language, forced, verdict``; verdict is ``take`` or why not, in order of the rules."""
    config = config or Discovery()
    p = F.col("path")
    forced = paths.any_of(*(paths.glob(p, g) for g in config.include))
    excluded = paths.any_of(*(paths.glob(p, g) for g in config.exclude))
    inside = F.startswith(p, F.lit(config.folder.rstrip("/") + "/")) if config.folder else F.lit(True)
    unless = lambda c: ~F.col("forced") & c
    verdict = (F.when(paths.blocked_folder(p), "folder").when(~inside, "outside").when(excluded, "excluded")
               .when(unless(paths.lock_file(p)), "lock").when(unless(paths.generated_file(p)), "generated").when(unless(paths.hidden_file(p)), "hidden")
               .when(unless(paths.blocked_extension(p)), "extension").when(F.col("bytes") > config.max_file_size, "oversize").when(F.col("bytes") == 0, "empty")
               .when(unless(F.col("language").isNull()), "unknown").otherwise("take"))
    return files.withColumn("language", paths.language(p)).withColumn("forced", forced).withColumn("verdict", verdict)


def discover(spark: SparkSession, root: str, config: Discovery | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to take ``path, bytes, parse_order, language``; recognised files that are too large ``path, bytes``)."""
    config = config or Discovery()
    rows = list(walk(root))
    listed = candidates(spark.createDataFrame(rows, "path string, bytes long, parse_order long"), config)
    taken = listed.filter("verdict = 'take' and language is not null")
    if taken.count() > config.max_files:
        raise TooManyFiles(f"more than {config.max_files} files; set MAX_FILES or narrow the folder")
    return taken.select("path", "bytes", "parse_order", "language"), listed.filter("verdict = 'oversize' and language is not null").select("path", "bytes")


SHIP_BYTES = 64 << 20


def ship(files: DataFrame, root: str, folder: str) -> DataFrame:
    """``path, content`` of ``files(path, bytes)`` as a table in the shared ``folder``, written by the driver in batches; a file that can't be read has no content."""
    spark, batch, size = files.sparkSession, [], 0

    def write() -> None:
        spark.createDataFrame(batch, "path string, content binary").write.mode("append").parquet(folder)

    for r in files.select("path").toLocalIterator():
        try:
            with open(os.path.join(root, r["path"]), "rb") as f:
                data = f.read()
        except OSError:
            data = None
        batch.append((r["path"], bytearray(data) if data is not None else None))
        size += len(data or b"") + 100
        if size > SHIP_BYTES:
            write()
            batch, size = [], 0
    write()
    return spark.read.schema("path string, content binary").parquet(folder)


def read_files(files: DataFrame, root: str, shipped: DataFrame | None = None) -> DataFrame:
    """``path, language, parse_order, content`` with bytes that are not UTF-8 left out; opened by the tasks, or taken from ``shipped(path, content)``."""
    if shipped is not None:
        def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(content=[None if c is None else bytes(c).decode("utf-8", "ignore") for c in frame["content"]])

        rows = files.select("path", "language", "parse_order").join(shipped, "path", "left").select("path", "language", "parse_order", "content")
        return rows.mapInPandas(decode, "path string, language string, parse_order long, content string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for p in frame["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        texts.append(f.read().decode("utf-8", "ignore"))
                except OSError:
                    texts.append(None)
            yield frame[["path", "language", "parse_order"]].assign(content=texts)

    return files.select("path", "language", "parse_order").mapInPandas(run, "path string, language string, parse_order long, content string")


def parse_mode(files: DataFrame, config: Discovery | None = None) -> DataFrame:
    """``files(language, content)`` with ``mode``: ``full``, or ``passthrough`` for files that become a vertex without elements."""
    config = config or Discovery()
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    minified = (lines > 0) & (lines < registry.MINIFIED_LINES) & (F.length("content") / lines > registry.MINIFIED_WIDTH)
    plain = F.col("language").isin(registry.PASSTHROUGH) | ~F.col("language").isin(registry.STRUCTURAL)
    large = (F.length("content") > config.max_chars) | (lines > config.max_lines)
    return files.withColumn("mode", F.when(F.col("content").isNull(), "failed").when(plain | large | minified, "passthrough").otherwise("full"))


def matches(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(path, p) for p in patterns)
