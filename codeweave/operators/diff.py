"""Element diff of two graph states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import identity as ident


def state(elements: DataFrame) -> DataFrame:
    """``anchor_key, hashes``: the multiset of signature hashes of each anchor, in order; null anchors are left out."""
    return elements.filter("anchor_key is not null").groupBy("anchor_key").agg(F.array_sort(F.collect_list("signature_hash")).alias("hashes"))


def compute_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change_type, anchor_key, kind, file, qualified_name, old_signature, signature_hash`` of anchors whose multisets differ.

    A signature is the greatest of its multiset. Anchors repeat, so both sides are grouped before they meet.
    """
    a, b = state(old).withColumnRenamed("hashes", "before"), state(new).withColumnRenamed("hashes", "after")
    both = a.join(b, "anchor_key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "DELETED").otherwise("CHANGED")
    key = F.col("anchor_key")
    return both.select(
        kind.alias("change_type"), "anchor_key", ident.anchor_part(key, "kind").alias("kind"), ident.anchor_part(key, "file").alias("file"),
        ident.anchor_part(key, "name").alias("qualified_name"), F.element_at("before", -1).alias("old_signature"), F.element_at("after", -1).alias("signature_hash"))


def summary(diff: DataFrame, first_parse: bool = False) -> DataFrame:
    c = F.col("change_type")
    return diff.agg(F.count_if(c == "ADDED").alias("added"), F.count_if(c == "CHANGED").alias("changed"), F.count_if(c == "DELETED").alias("deleted")).withColumn("first_parse", F.lit(first_parse))


def entries(diff: DataFrame, each: int) -> DataFrame:
    """Up to ``each`` entries of every kind of change, in order of anchor: what a report shows."""
    parts = [diff.filter(F.col("change_type") == k).orderBy("anchor_key").limit(each) for k in ("ADDED", "CHANGED", "DELETED")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
