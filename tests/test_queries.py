"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quadrille.queries import ORACLES, QUERIES
from quadrille.queries.relational import TABLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(rows) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_whole_tables(spark, sf):
    """No key range is left out, and NULLs come first with all others in order behind them."""
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "part")}
    pairs = QUERIES["sp_both_sides_operand"](spark, sf).toPandas()
    assert pairs.c_custkey.max() >= 40 and QUERIES["dml_insert"](spark, sf).count() == 2 * rows["customer"] + 2
    assert QUERIES["join_computed_key"](spark, sf).toPandas().a.max() >= min(200, rows["part"] - 50)
    got = [(r["n"], r["c_custkey"]) for r in QUERIES["sort_nulls"](spark, sf).collect()]
    assert len(got) == rows["customer"] and got == sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
