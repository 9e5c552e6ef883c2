"""Spatial joins written in SQL become grid joins with the same rows."""

from __future__ import annotations

import pytest

from quadrille.engine import Engine
from quadrille.plans import spatial_sql
from tests import fixtures


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("geo", fixtures.geom_data(spark).select("__FID__", "I", "pt", "line"))
    e.register("simple", fixtures.geom_simple(spark).withColumnRenamed("I2", "I"))
    return e


GRID = [
    "SELECT a.__FID__, b.fid2, a.I + b.I AS s FROM geo a JOIN simple b ON ST_Contains(b.poly2, a.pt)",
    "SELECT a.__FID__, fid2 FROM geo AS a LEFT OUTER JOIN simple AS b ON ST_Within(pt, poly2) AND b.I > 3",
    "SELECT a.__FID__ AS f, b.fid2 FROM geo a RIGHT JOIN simple b ON ST_Within(a.pt, b.poly2) AND a.I < 7",
    "SELECT count(*) AS n, max(a.I) AS m FROM geo a FULL JOIN simple b ON ST_DWithin(a.pt, b.pt2, 1.1) WHERE b.I IS NULL OR a.I > 2",
    "SELECT b.I, count(*) AS n FROM geo a, simple b WHERE ST_Intersects(ST_Buffer(a.pt, 0.5D), b.line2) AND a.I <> 4 GROUP BY b.I HAVING count(*) > 1 ORDER BY b.I LIMIT 5",
    "SELECT x.__FID__ FROM (SELECT * FROM geo WHERE I > 3) x JOIN simple ON ST_Touches(simple.poly2, x.line) OR FALSE",
    "SELECT * FROM (SELECT __FID__, pt FROM geo) a JOIN (SELECT fid2, poly2 FROM simple) b ON ST_Intersects(a.pt, b.poly2)",
    "WITH a AS (SELECT * FROM geo WHERE I > 3), b AS (SELECT * FROM simple) SELECT a.__FID__, b.fid2 FROM a, b WHERE ST_Within(a.pt, b.poly2)",
    "WITH a AS (SELECT x.I AS k, y.fid2 AS g FROM geo x JOIN simple y ON ST_Contains(y.poly2, x.pt)) SELECT k, count(*) AS n FROM a AS z WHERE k > 2 GROUP BY k",
    "SELECT q.g, count(*) AS n FROM (SELECT y.fid2 AS g FROM geo x JOIN simple y ON ST_Contains(y.poly2, x.pt) WHERE x.I < 9) q GROUP BY q.g",
    "SELECT a.__FID__, b.fid2, c.two FROM geo a JOIN simple b ON ST_Contains(b.poly2, a.pt) LEFT JOIN (SELECT fid2 AS f, I * 2 AS two FROM simple WHERE I > 4) c ON c.f = b.fid2 WHERE a.I > 1",
    "SELECT a.__FID__, b.fid2, c.fid3 FROM geo a JOIN simple b ON ST_Contains(b.poly2, a.pt) JOIN (SELECT fid2 AS fid3, poly2 AS poly3 FROM simple) c ON ST_Within(a.pt, c.poly3)",
]


@pytest.mark.parametrize("text", GRID)
def test_rows_equal_the_nested_loop(engine, text):
    got, want = engine.sql(text), engine.spark.sql(text)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("NestedLoop" in plan or "Cartesian" in plan) == ("OR FALSE" in text)


@pytest.mark.parametrize(
    ("text", "args"),
    [
        ("SELECT a.__FID__, b.fid2 FROM geo a JOIN simple b ON ST_DWithin(a.pt, b.pt2, ?) WHERE b.fid2 <> ? AND a.I < ?", [1.1, "it's #3\\", 15]),
        ("SELECT a.__FID__, b.fid2 FROM geo a JOIN simple b ON ST_Contains(b.poly2, a.pt) AND a.I > :least", {"least": 4}),
    ],
)
def test_parameters(engine, text, args):
    got, want = engine.sql(text, args), engine.spark.sql(text, args)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.I FROM geo a JOIN simple b ON ST_Contains(ST_Union(a.pt, b.poly2), b.pt2)",
        "SELECT a.I FROM geo a JOIN simple b ON a.I = b.I WHERE ST_Contains(b.poly2, a.pt)",
        "SELECT I FROM geo WHERE ST_Within(pt, ST_MakeEnvelope(0,0,2,2))",
        "WITH x AS (SELECT 1 AS one) SELECT one FROM x WHERE ST_Within(ST_MakePoint(0,0), ST_MakeEnvelope(0,0,2,2))",
        "SELECT a.I FROM geo a JOIN simple b ON ST_DWithin(a.pt, b.pt2, b.I)",
    ],
)
def test_other_queries_are_left_alone(engine, text):
    assert spatial_sql.rewrite(engine.spark, text) is None
    assert engine.sql(text).count() == engine.spark.sql(text).count()


def test_spatial_conditions_prune_the_scan(spark, tmp_path):
    from quadrille.operators.feature_table import FeatureTable

    e = Engine(spark)
    table = FeatureTable.create(spark, f"file://{tmp_path}/m", fixtures.MODIFY, fixtures.modify_rows(spark, 60))
    e.register("feat", table)
    assert e.table("feat").columns == fixtures.MODIFY.names and e.sql("SELECT * FROM feat").columns == fixtures.MODIFY.names
    for condition in ("ST_Within(geom, ST_MakeEnvelope(9.5, 0, 20.5, 99))", "ST_DWithin(ST_MakePoint(15, 16), f.geom, 7.2D)", "ST_Intersects(f.geom, ST_GeomFromText('POLYGON((5 0, 30 0, 5 30, 5 0))')) AND f.I > 6"):
        text = f"SELECT f.I, count(*) AS n FROM feat f WHERE {condition} GROUP BY f.I ORDER BY f.I"
        got, want = e.sql(text), spark.sql(text)
        assert got.collect() == want.collect() and got.count() > 5
        assert "__geom_x1" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert e.sql("UPDATE feat SET geom = ST_MakePoint(500D, 500D) WHERE I = 3") == 1
    assert [r[0] for r in e.sql("SELECT I FROM feat WHERE ST_Within(geom, ST_MakeEnvelope(400, 400, 600, 600))").collect()] == [3]
    assert [r["I"] for r in table.search("geom", "within", "POLYGON((400 400, 600 400, 600 600, 400 600, 400 400))").collect()] == [3]
    assert e.sql("DELETE FROM feat WHERE ST_Within(geom, ST_MakeEnvelope(400, 400, 600, 600))") == 1 and e.table("feat").count() == 59
