"""Registered queries and their DuckDB twins, by subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.queries import relational, spatial, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**relational.QUERIES, **spatial.QUERIES, **tables.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **spatial.ORACLES, **tables.ORACLES}
