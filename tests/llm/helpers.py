"""Small tables with every awkward case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LONG = "word after word " * 20_000
#: Names that operators use inside themselves.
CLASHING = ["len", "prefix", "text_sha256", "kept", "fp", "mask", "key", "value", "count", "n", "id", "y", "__id", "__row_sha", "__base", "__spans", "__rid", "score", "n_tokens", "sample"]


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, empty and blank texts, a very long one, repeated rows, ties and clashing columns."""
    rows = [
        (1, "one two three four"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG), (7, "one  two\tthree four"),
        (7, "one  two\tthree four"), (None, "one two three four"), (None, None), (8, "😀 ünïcode ▁ text"), (9, "x" * 300), (10, "password = hunter2hunter2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark).limit(0)
