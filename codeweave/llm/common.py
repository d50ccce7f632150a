"""Shared helpers of the training-data operators: table reads, intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` as the session has it.

    Only where the setting is absent and all runs in one process (tests) a local folder is made and kept in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage as checkpoint() does, survives the loss of any executor, and is columnar and compressed.
    """
    path = f"{scratch_dir(df.sparkSession)}/codeweave/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As :func:`settle`, in as many buckets of ``key`` as the session has shuffle partitions.

    A later join or aggregation by ``key`` then moves only its other side. The table's name leaves the catalog at once, its files stay.
    """
    spark = df.sparkSession
    name = f"codeweave_{label}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
     .option("path", f"{scratch_dir(spark)}/codeweave/{name}").saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


#: A key that holds one in HEAVY rows is a heavy one; there are at most HEAVY of them, whatever the size of the data.
HEAVY = 4096


def spread_join(big: DataFrame, small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row a key and in ``weight`` at least a share of the key's rows in ``big``.

    Keys of 1 / HEAVY of all weight or more are broadcast, at most HEAVY rows by that very rule, so their rows stay where they are; the
    others are joined by a shuffle, in which no key is large. ``small`` should be settled, as it is read three times.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY >= F.lit(total)
    heavy, light = small.filter(is_heavy), small.filter(~is_heavy)
    if total and total <= HEAVY:  # a table of a few rows: every key counts as heavy
        return big.join(F.broadcast(small), on)
    out = big.join(light, on)
    if heavy.take(1):
        out = out.unionByName(big.join(F.broadcast(heavy), on))
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_name(text: str = "text") -> Column:
    """SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), 256)


def one_row_each(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of ``docs``, with its own columns, for each distinct ``doc_id, sha, n`` of ``winners``; ``n`` rows have that id and text.

    Only rows that are repeated are moved for a choice among them; all others pass a semi-join.
    """
    keys = winners.select(F.col("doc_id").alias("__w_id"), F.col("sha").alias("__w_sha"), F.col("n").alias("__w_n"))
    at = lambda k: docs["doc_id"].cast("long").eqNullSafe(k["__w_id"]) & (text_name() == k["__w_sha"])
    single, many = keys.filter("__w_n = 1"), keys.filter("__w_n > 1")
    out = docs.join(single, at(single), "left_semi")
    if not many.take(1):
        return out
    first = Window.partitionBy("__w_id", "__w_sha").orderBy(F.to_json(F.struct(*(docs[c] for c in docs.columns))))
    chosen = docs.join(many, at(many)).withColumn("__w_place", F.row_number().over(first)).filter("__w_place = 1").select(*docs.columns)
    return out.unionByName(chosen)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)``, root = the smallest node reachable.

    Local contraction: each round every node moves to the member of its closed neighbourhood with the least
    hash (a new hash each round), so the graph shrinks by a constant factor in expectation and the number of
    rounds is logarithmic whatever the diameter. Aggregations are combined on the map side and the joins are
    plain equi-joins, so a hub with very many neighbours does not land in one task. Nothing but one row count a
    round reaches the driver. Nodes without an edge to another node are absent from the result.
    """
    live = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    for r in range(max_rounds):
        if not live.take(1):
            break
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("v"))
        move = settle(
            both.groupBy("a").agg(F.min(rank("b")).alias("best"))
            .select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["v"].alias("to")), "move")
        moves.append(move)
        x, y = move.toDF("a", "ta"), move.toDF("b", "tb")
        live = settle(
            live.join(x, "a").join(y, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .filter("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not moves:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    end = moves[0]
    for move in moves[1:]:
        end = (end.join(move.toDF("to", "next"), "to", "left")
               .select("node", F.coalesce("next", "to").alias("to")))
    least = end.groupBy("to").agg(F.min("node").alias("root"))
    return settle(end.join(least, "to").select("node", "root"), "components")
