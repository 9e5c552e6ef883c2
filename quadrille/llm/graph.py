"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.llm.storage import materialise, release


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _step(edges: DataFrame) -> DataFrame:
    """One large-star, then one small-star step over edges (u > v)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    parent = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(parent.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has an edge: node, component (the smallest node it reaches).

    Self-loops, repeated edges, edges in both directions and edges with a null end are allowed and change nothing.
    Each step is written to the shared folder, so lineage stays short and a lost executor costs one step. Only a
    count and a checksum reach the driver. The number of steps grows with the logarithm of the number of nodes.
    """
    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))
    )
    now = materialise(oriented.distinct(), "edges")
    mark = _signature(now)
    while mark[0]:
        then = materialise(_step(now), "edges")
        before, mark = mark, _signature(then)
        release(now)
        now = then
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
