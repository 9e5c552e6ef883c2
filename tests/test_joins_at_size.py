"""Joins of sides whose geometries repeat: tested once for each pair of geometries, spread over the session's tasks."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quadrille.geometry.native import Box, Point, Wkb
from quadrille.operators import spatial_join as op
from quadrille.queries import QUERIES
from tests.fixtures import nested_loop

SPREAD = [
    "sp_sql_join_overlaps",
    "sp_sql_join_touches",
    "sp_sql_join_equals",
    "sp_sql_join_buffer",
    "sp_join_boxes",
    "sp_sql_join_three",
    "sp_sql_join_crosses",
    "sp_join_contains_wkb",
    "sp_sql_join_derived",
    "sp_sql_join_cte",
]


@pytest.mark.parametrize("name", SPREAD)
def test_rows_are_dealt_by_their_geometry(spark, sf, name):
    """However few files its sides have, a join runs in at least three tasks a core, and joins geometries before rows."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for side in ("__aid", "__bid"):
        dealt = [int(n) for n in re.findall(rf"hashpartitioning\({side}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(dealt) >= 2 and set(dealt) == {op.tasks(spark)} and op.tasks(spark) >= 12


def sides(spark, n, m):
    """Points of which one has half of ``n`` rows and boxes of which one has half of ``m``; some are NULL."""
    a = spark.range(n).selectExpr("id AS aid", "CASE WHEN id % 2 = 0 THEN 1D WHEN id % 31 <> 1 THEN CAST(id % 7 AS DOUBLE) END AS x", "CAST(id % 2 AS DOUBLE) AS y")
    b = spark.range(m).selectExpr("id AS bid", "IF(id % 29 = 0, NULL, IF(id % 2 = 0, 0D, CAST(id % 5 AS DOUBLE))) AS x0", "-1D AS y0").selectExpr("*", "x0 + 2 AS x1", "3D AS y1")
    return a.selectExpr("*", "ST_MakePoint(x, y) AS ag"), b.selectExpr("*", "ST_MakeEnvelope(x0, y0, x1, y1) AS bg")


@pytest.mark.parametrize("how", ["inner", "left", "full", "left_anti"])
def test_chunks_of_common_geometries(spark, monkeypatch, how):
    monkeypatch.setattr(op, "CHUNK", 16)
    a, b = sides(spark, 300, 200)
    extra = (F.col("aid") + F.col("bid")) % 3 == 0
    want = sorted(map(str, nested_loop(a, b, "within", Wkb("ag"), Wkb("bg"), how, None, extra).drop("ag", "bg").collect()))
    for shapes in ((Wkb("ag"), Wkb("bg")), (Point("x", "y"), Box("x0", "y0", "x1", "y1"))):
        got = op.spatial_join(a, b, "within", *shapes, how, extra=extra).drop("ag", "bg")
        assert sorted(map(str, got.collect())) == want and len(want) > 100 or how == "left_anti"


def test_sides_that_vary_are_read_once(spark):
    a, b = sides(spark, 300, 40)
    some = a.orderBy(F.rand()).limit(90)
    joined = op.spatial_join(some, b, "within", Wkb("ag"), Wkb("bg"), "left")
    assert joined.select("aid").distinct().count() == 90
    assert sorted(map(str, joined.where("bid IS NOT NULL").drop("ag", "bg").collect())) == sorted(map(str, nested_loop(joined.select(a.columns).distinct(), b, "within", Wkb("ag"), Wkb("bg")).drop("ag", "bg").collect()))


def test_operand_of_both_sides(spark, sf):
    a, b = sides(spark, 300, 40)
    text = "ST_Area(ST_Envelope(ST_Union(ag, bg))) < 9.5D"
    got = op.pair_join(a, b, Wkb("ag"), Wkb("bg"), F.expr(text)).drop("ag", "bg")
    want = a.join(b, F.expr(text)).drop("ag", "bg")
    assert got.count() > 100 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = QUERIES["sp_both_sides_operand"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__aid" in plan and "hashpartitioning(__bid" in plan
