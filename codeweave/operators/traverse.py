"""Traversals over ``edges(etype, src, dst)``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_types(edges: DataFrame, *etypes: str) -> DataFrame:
    return edges.filter(F.col("etype").isin(*etypes)) if etypes else edges


def step(start: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """``v`` one edge away from ``start(v)``: ``out``, ``in`` or ``both``; one row an edge. Neither side goes through the driver."""
    out = edges.select(F.col("src").alias("v"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("v"), F.col("src").alias("to"))
    way = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return start.select("v").hint("merge").join(way.hint("merge"), "v").select(F.col("to").alias("v"))


def khop(start: DataFrame, edges: DataFrame, hops: int, direction: str = "out", settle: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """``v, hop``: vertices reached within ``hops`` edges, with the least number of edges; the start has 0.

    ``settle`` writes each hop's vertices to shared storage, so that a hop is computed once and not again by every later one.
    """
    rings = [settle(start.select("v").distinct().withColumn("hop", F.lit(0)), "ring")]
    for k in range(1, hops + 1):
        new = step(rings[-1], edges, direction).distinct()
        for ring in rings:
            new = new.join(ring.select("v").hint("merge"), "v", "left_anti")
        rings.append(settle(new.withColumn("hop", F.lit(k)), "ring"))
    return functools.reduce(DataFrame.unionByName, rings)


def closure(start: DataFrame, edges: DataFrame, settle: Callable[[DataFrame, str], DataFrame], direction: str = "out", max_rounds: int = 1000) -> DataFrame:
    """``v, hop`` of everything reachable. ``settle`` writes a round to shared storage, so lineage stays one round long."""
    seen = frontier = settle(start.select("v").distinct().withColumn("hop", F.lit(0)), "frontier")
    for k in range(1, max_rounds + 1):
        frontier = settle(step(frontier, edges, direction).distinct().join(seen.hint("merge"), "v", "left_anti").withColumn("hop", F.lit(k)), "frontier")
        if not frontier.take(1):
            return seen
        seen = settle(seen.unionByName(frontier), "seen")
    raise RuntimeError("closure did not end")


def containment(dirs: DataFrame, ancestors) -> DataFrame:
    """All (ancestor, path) pairs of a tree from the paths themselves: no recursion."""
    return dirs.select("path", F.explode(ancestors(F.col("path"))).alias("ancestor"))


def degrees(edges: DataFrame) -> DataFrame:
    """``v, fan_in, fan_out``."""
    ends = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("v").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))
