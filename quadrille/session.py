"""Session factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results of time functions must not depend on where the driver runs; the rest lets Spark re-plan from run-time sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``. On a cluster leave ``master`` and ``shuffle_partitions`` to its configuration."""
    builder = SparkSession.builder.appName("quadrille")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map={**SETTINGS, **settings}).getOrCreate()
