"""Change notices as a stream: commits drop small JSON files, micro-batches parse each project once.

A notice that is missed costs nothing: the next parse of its project derives all changes since the stored commit, so it only is
a larger batch. Notices of one micro-batch are reduced to one a project.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "project string, repo string, trigger string"


def notices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def coalesced(batch: DataFrame) -> DataFrame:
    """``project, repo, notices``: one row a project."""
    return batch.filter("project is not null and repo is not null").groupBy("project").agg(F.max("repo").alias("repo"), F.count(F.lit(1)).alias("notices"))


def run(stream: DataFrame, parse: Callable[[str, str], object], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Call ``parse(project, repo)`` for each project of each micro-batch; a project list is small, one row each."""
    def act(batch: DataFrame, _: int) -> None:
        for r in coalesced(batch).toLocalIterator():
            parse(r["project"], r["repo"])

    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def notice_rates(stream: DataFrame, ts: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Notices a project and window, with late ones dropped after the watermark; for a stream that carries times."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "project").agg(F.count(F.lit(1)).alias("notices"))
