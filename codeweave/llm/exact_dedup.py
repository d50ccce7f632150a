"""Exact dedup (operator 8): content-defined chunk recipes.

Method. Every normalised text (A-Z lower-cased, nothing else) is cut at content-defined places: where a multiplicative
hash of the last eight bytes has twelve leading zeros, with a least and a greatest length. A chunk is named by its
SHA-256; the chunks are deduplicated by name, each distinct chunk's bytes moving once (combined on the map side), and
every name is verified to stand for one byte string. A document is then only its recipe, the ordered list of verified
names, a hundredth of its size; documents are equal when their recipes are. If a name ever stood for two byte strings,
the documents that use it are compared with those chunks' bytes added to the recipe, so the result stays exact.

Defined cases: null text counts as empty, and all empty texts are one group; of equal texts the largest id stays; a null
id never wins over another one; repeated rows of one id are all listed and carry the same ``kept``; an empty table gives
an empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import one_row_each, settle

LEAST, MOST, ZERO_BITS = 2048, 1 << 16, 12
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - ZERO_BITS)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one included; none for no bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    windows = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    marks = np.flatnonzero((windows * MULTIPLIER) >> SHIFT == 0) + 8
    ends, last, k = [], 0, 0
    while n - last > LEAST:
        k = int(np.searchsorted(marks, last + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, last + MOST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def name_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _recipes(name: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hexes, sizes = [], [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode().lower()
                lists.append([name(c) for c in chunks(data)])
                hexes.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.binary())), pa.array(sizes, pa.int64()), pa.array(hexes, pa.string())],
                ["doc_id", "recipe", "n_bytes", "text_sha256"])
    return run


def _store(name: Callable[[bytes], bytes], with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(1):
                data = (value.as_py() or "").encode().lower()
                if not (parts := chunks(data)):
                    continue
                cols = [pa.array([name(c) for c in parts], pa.binary()), pa.array(parts, pa.binary())]
                names = ["name", "chunk"]
                if with_place:
                    cols += [pa.array([hashlib.sha256(data).hexdigest()] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64())]
                    names += ["text_sha256", "place"]
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def recipes(docs: DataFrame, name: Callable[[bytes], bytes] = name_of) -> DataFrame:
    """``doc_id, recipe array<binary>, n_bytes, text_sha256, extra``: verified recipes of all documents.

    ``extra`` is empty unless a name stands for several byte strings; then it holds those chunks' bytes in order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = rows.mapInArrow(_recipes(name), "doc_id long, recipe array<binary>, n_bytes long, text_sha256 string")
    store = rows.mapInArrow(_store(name, False), "name binary, chunk binary")
    doubtful = settle(store.groupBy("name").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo <> hi").select("name"), "doubtful")
    none = F.array().cast("array<binary>")
    if not doubtful.take(1):
        return listed.withColumn("extra", none)
    placed = rows.mapInArrow(_store(name, True), "name binary, chunk binary, text_sha256 string, place long")
    extra = (placed.join(doubtful, "name", "left_semi").groupBy("text_sha256")
             .agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "chunk"))), lambda x: x["chunk"]).alias("more")))
    return listed.join(extra, "text_sha256", "left").withColumn("extra", F.coalesce("more", none)).drop("more")


def exact_duplicates(docs: DataFrame, name: Callable[[bytes], bytes] = name_of) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``."""
    listed = settle(recipes(docs, name), "recipes")
    key = ["n_bytes", "recipe", "extra"]
    # written before the join: an aggregation in the join's own stage would keep AQE from splitting a large group of copies
    groups = settle(listed.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return listed.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without exact copies: of equal texts one row with the largest id stays, with its own columns."""
    kept = exact_duplicates(docs).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    return one_row_each(docs, settle(kept, "kept"))
