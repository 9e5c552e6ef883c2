"""Column helpers for scalar functions that Spark spells differently, and spatial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def truncate(x: Column, digits: int = 0) -> Column:
    """``x`` cut towards zero after ``digits`` decimals."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def similar_to(x: Column, pattern: str) -> Column:
    from quadrille.plans.literals import similar

    return x.rlike(similar(pattern))


#: Geometries that one task unites at a time, on average.
FAN = 256


def union_agg(df: DataFrame, keys: list[str], geom: str, name: str = "geom", fan: int = FAN) -> DataFrame:
    """Union of the geometries of each group (null ones left out; null where there are no others).

    Equal geometries of a group count once, by a grouping that combines in the map tasks. What is left is united in
    levels: parts of about ``fan`` geometries at a time, then their unions, so no task holds a large group's geometries.
    """
    rows = df.groupBy(*keys, F.col(geom).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    parts = max(1, -(-rows.count() // fan))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__g"), F.lit(parts)))
    while True:
        rows = rows.groupBy(*keys, "__part").agg(F.call_function("ST_UnionAll", F.collect_list("__g")).alias("__g"))
        if parts == 1:
            return rows.select(*keys, F.col("__g").alias(name))
        parts = -(-parts // fan)
        rows = rows.withColumn("__part", F.pmod("__part", F.lit(parts)))
