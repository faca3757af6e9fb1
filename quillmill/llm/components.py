"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b: long) to rows (node, root): each node of an edge with the smallest node that it reaches.

    Nulls and loops are no edges. Every round writes its edges to the shared folder, so lineage stays short and a
    lost executor costs one round. Each join has a plain exchange on both sides, which lets Spark split a node with
    very many edges over several tasks; minima are pre-aggregated before the shuffle.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(big.alias("a"), small.alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = materialize(both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        discard(now)
        discard(lowest)
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        pairs = large.join(lowest, "a").select("a", "b", "m")
        rays = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialize(rays.where("a <> b").distinct(), "edges")
        discard(large)
        discard(lowest)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
