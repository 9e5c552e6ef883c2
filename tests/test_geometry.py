"""Geometry functions and spatial joins: native forms against JTS, grid joins against nested loops, and plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import similar_to, truncate, union_agg
from quadrille.geometry import jts
from quadrille.geometry.native import Box, Point, Wkb, as_wkb, exact
from quadrille.operators.prefilter import spatial_filter
from quadrille.operators.spatial_join import spatial_join
from quadrille.queries.spatial import PT, points
from quadrille.sources import readers
from quadrille.streaming import sessions, windowed_counts
from tests import fixtures
from tests.fixtures import nested_loop


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    jts.register(spark)


def one(spark, expression):
    return spark.sql(f"SELECT {expression}").first()[0]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("ST_AsText(ST_GeomFromText('POINT(1 1)'))", "POINT (1 1)"), ("ST_GeometryType(ST_GeomFromText('LINESTRING(0 0, 1 1)'))", "LINESTRING"), ("ST_Crosses(ST_GeomFromText('LINESTRING(0 0, 2 2)'), ST_GeomFromText('LINESTRING(0 2, 2 0)'))", True),
        ("ST_Touches(ST_MakeEnvelope(0,0,1,1), ST_MakeEnvelope(1,0,2,1))", True), ("ST_Overlaps(ST_MakeEnvelope(0,0,2,2), ST_MakeEnvelope(1,1,3,3))", True), ("ST_Relate(ST_MakePoint(0,0), ST_MakePoint(0,0))", "0FFFFFFF2"),
        ("ST_RelateTo(ST_MakePoint(0,0), ST_MakePoint(0,0), 'T********')", True), ("ST_NPoints(ST_Densify(ST_GeomFromText('LINESTRING(0 0, 4 0)'), 1D))", 5), ("ST_AsText(ST_Simplify(ST_GeomFromText('LINESTRING(0 0, 1 0.01, 2 0)'), 0.1D))", "LINESTRING (0 0, 2 0)"),
        ("ST_AsText(ST_StartPoint(ST_GeomFromText('LINESTRING(0 0, 4 0)')))", "POINT (0 0)"), ("ST_AsText(ST_PointN(ST_GeomFromText('LINESTRING(0 0, 4 0)'), 2))", "POINT (4 0)"), ("ST_PointN(ST_GeomFromText('LINESTRING(0 0, 4 0)'), 9)", None),
        ("ST_AsText(ST_GeometryN(ST_GeomFromText('MULTIPOINT(0 0, 2 2)'), 2))", "POINT (2 2)"), ("ST_NumGeometries(ST_Delaunay(ST_GeomFromText('MULTIPOINT(0 0, 2 0, 1 2)')))", 1), ("ST_Dimension(ST_GeomFromText('POINT(1 2)'))", 0),
        ("ST_AsText(ST_ClosestPoint(ST_GeomFromText('LINESTRING(0 0, 4 0)'), ST_MakePoint(2, 5)))", "POINT (2 0)"), ("ST_MaxDistance(ST_MakePoint(0,0), ST_MakeEnvelope(0,0,3,4))", 5.0), ("ST_IsClosed(ST_GeomFromText('LINESTRING(0 0, 4 0)'))", False),
        ("ST_IsRing(ST_ExteriorRing(ST_MakeEnvelope(0,0,1,1)))", True), ("ST_AsText(ST_Reverse(ST_GeomFromText('LINESTRING(0 0, 4 0)')))", "LINESTRING (4 0, 0 0)"), ("round(ST_X(ST_Rotate(ST_MakePoint(1,0), pi())), 6)", -1.0), ("ST_Z(ST_GeomFromText('POINT Z(1 2 3)'))", 3.0),
        ("ST_AsEWKT(ST_GeomFromEWKT('SRID=4326;POINT(1 2)'))", "SRID=4326;POINT (1 2)"), ("ST_GeometryTypeCode(ST_MakeEnvelope(0,0,1,1))", 3), ("ST_Contains(NULL, ST_MakePoint(0,0))", None), ("ST_IsValid(ST_GeomFromText('POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))'))", False),
        ("ST_AsText(ST_MakePolygon(ST_GeomFromText('LINESTRING(0 0, 1 0, 1 1, 0 0)')))", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("ST_NumInteriorRings(ST_Difference(ST_MakeEnvelope(0,0,9,9), ST_MakeEnvelope(1,1,2,2)))", 1), ("size(ST_MakeGridPoints(ST_MakeEnvelope(0,0,2,2), 1D, 1D))", 4),
        ("ST_HausdorffDistance(ST_MakePoint(0,0), ST_MakePoint(0,3))", 3.0), ("ST_CoveredBy(ST_MakePoint(0,0), ST_MakeEnvelope(0,0,1,1))", True), ("ST_ContainsProperly(ST_MakeEnvelope(0,0,1,1), ST_MakePoint(0,0))", False), ("ST_AsText(ST_Normalize(ST_GeomFromText('MULTIPOINT(2 2, 0 0)')))", "MULTIPOINT ((0 0), (2 2))"),
    ],
)
def test_functions(spark, expression, want):
    assert one(spark, expression) == want


def test_literal_rows_are_prepared_once_and_right(spark):
    df = spark.range(50).selectExpr("ST_MakePoint(CAST(id AS DOUBLE), 0D) AS p")
    n = df.where("ST_Within(p, ST_GeomFromText('POLYGON((-1 -1, 10.5 -1, 10.5 1, -1 1, -1 -1))'))").count()
    assert n == 11 and df.where("ST_Contains(ST_GeomFromText('POLYGON((-1 -1, 10.5 -1, 10.5 1, -1 1, -1 -1))'), p)").count() == 11


def test_all_kinds_of_geometry(spark):
    row = fixtures.geom_data(spark).selectExpr("ST_Area(ST_Buffer(polys, 0.1D)) > 0 AS b", "ST_NumGeometries(geoms) AS n", "ST_Length(lines) = 2 * ST_Length(line) AS l", "ST_Area(poly) AS a", "ST_GeometryType(points) AS k").first()
    assert row[:] == (True, 2, True, 200.0, "MULTIPOINT")


@pytest.mark.parametrize("predicate", ["contains", "within", "intersects", "equals", "dwithin"])
@pytest.mark.parametrize("kinds", ["pp", "pb", "bp", "bb"])
def test_native_equals_jts(spark, predicate, kinds):
    rng = random.Random(hash(predicate + kinds) % 97)
    v = lambda: float(rng.randint(0, 6))
    rows = []
    for _ in range(400):
        r = []
        for k in kinds:
            x, y = v(), v()
            r += [x, y, x + (rng.randint(1, 3) if k == "b" else 0), y + (rng.randint(1, 3) if k == "b" else 0)]
        rows.append(tuple(map(float, r)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    left = Point("a", "b") if kinds[0] == "p" else Box("a", "b", "c", "d")
    right = Point("e", "f") if kinds[1] == "p" else Box("e", "f", "g", "h")
    native = exact(predicate, left, right, 1.5)
    if native is None:
        pytest.skip("answered by JTS alone")
    want = F.call_function("ST_DWithin", as_wkb(left), as_wkb(right), F.lit(1.5)) if predicate == "dwithin" else F.call_function("__jts_test", F.lit(predicate), as_wkb(left), as_wkb(right))
    assert df.where(native != want).count() == 0


def shapes(spark, n, seed, prefix, huge=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.1, 1, 5]) if i >= huge else 90
        rows.append((i, x, y, x + s, y + s) if i % 17 else (i, None, None, None, None))
    df = spark.createDataFrame(rows, f"{prefix}id int, {prefix}x0 double, {prefix}y0 double, {prefix}x1 double, {prefix}y1 double")
    return df.withColumn(f"{prefix}g", F.call_function("ST_MakeEnvelope", *[f"{prefix}{c}" for c in ("x0", "y0", "x1", "y1")]))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize(("predicate", "distance"), [("intersects", None), ("dwithin", 1.3)])
def test_grid_join_equals_nested_loop(spark, how, predicate, distance):
    a, b = shapes(spark, 120, 1, "a", huge=3), shapes(spark, 90, 2, "b", huge=2)
    extra = F.col("aid") % 5 != 1
    out = [f(a, b, predicate, Wkb("ag"), Wkb("bg"), how, distance, extra).drop("ag", "bg") for f in (spatial_join, nested_loop)]
    assert sorted(map(str, out[0].collect())) == sorted(map(str, out[1].collect()))
    box = spatial_join(a, b, predicate, Box("ax0", "ay0", "ax1", "ay1"), Box("bx0", "by0", "bx1", "by1"), how, distance, extra, most_cells=4).drop("ag", "bg")
    assert sorted(map(str, box.collect())) == sorted(map(str, out[1].collect()))


@pytest.mark.parametrize("predicate", ["contains", "within", "crosses", "equals", "overlaps", "touches", "covers", "coveredby"])
def test_fixture_joins(spark, predicate):
    left, right = fixtures.geom_data(spark).select("__FID__", "pt", "poly"), fixtures.geom_simple(spark)
    out = [f(left, right, predicate, Wkb("pt"), Wkb("poly2")).select("__FID__", "fid2") for f in (spatial_join, nested_loop)]
    assert sorted(out[0].collect()) == sorted(out[1].collect())
    if predicate == "within":
        assert out[0].count() == 11 and spatial_join(left, right, predicate, Wkb("pt"), Wkb("poly2"), "left").count() == 121


def test_join_arguments(spark):
    a, b = shapes(spark, 5, 1, "a"), shapes(spark, 5, 2, "b")
    for bad in (("near", None, a), ("dwithin", None, a), ("within", 2.0, a), ("within", None, b)):
        with pytest.raises(ValueError):
            spatial_join(bad[2], b, bad[0], Wkb("ag"), Wkb("bg"), distance=bad[1])
    assert spatial_join(a.limit(0), b, "within", Wkb("ag"), Wkb("bg"), "full").count() == 5


def test_plans(spark, sf):
    joined = spatial_join(points(spark, sf, "customer", "c_custkey"), shapes(spark, 20, 1, "b"), "within", PT, Box("bx0", "by0", "bx1", "by1"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.range(10).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y").write.mode("overwrite").parquet("file:///tmp/quadrille-plan")
    df = spark.read.parquet("file:///tmp/quadrille-plan")
    found = spatial_filter(df, PT, "intersects", "POLYGON((0 0, 5 0, 0 5, 0 0))").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(x,5.0)" in plan.split("PushedFilters")[1] and found.count() == 3


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","id":"f1","properties":{"name":"L1","n":1},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}},'
        '{"type":"Feature","properties":{"name":"P","n":null},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{"name":"none","n":3},"geometry":null}]}'
    )
    df = readers.geojson(spark, f"file://{tmp_path}/a.geojson")
    rows = df.withColumn("t", F.call_function("ST_AsText", "geom")).orderBy("name").collect()
    assert df.columns == ["__FID__", "n", "name", "geom"] and [r["t"] for r in rows] == ["LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 2 0, 2 2, 0 0))", None] and rows[0]["__FID__"] == "f1"


def test_delimited_skips_bad_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("I,F,S\n1,0.5,x\nbad,1,y\n3,2.5,z\n")
    from quadrille.types import schema

    df = readers.delimited(spark, f"file://{tmp_path}/a.csv", schema("I:Integer,F:Float,S:String"), "I")
    assert [tuple(r) for r in df.collect()] == [("#1", 1, 0.5, "x"), ("#3", 3, 2.5, "z")]


def test_union_aggregate(spark):
    df = spark.range(40).selectExpr("id % 2 AS k", "ST_MakeEnvelope(CAST(id AS DOUBLE), 0D, CAST(id AS DOUBLE) + 1, 1D) AS g")
    for fan in (2, 3, 100):
        got = union_agg(df, ["k"], "g", fan=fan).select("k", F.call_function("ST_Area", "geom").alias("a")).collect()
        assert sorted(tuple(r) for r in got) == [(0, 20.0), (1, 20.0)]
    same = spark.range(2000).selectExpr("1 AS k", "if(id % 7 = 0, NULL, ST_MakePoint(1D, 2D)) AS g").unionAll(spark.sql("SELECT 2, CAST(NULL AS BINARY)"))
    assert sorted(tuple(r) for r in union_agg(same, ["k"], "g").selectExpr("k", "ST_AsText(geom) AS t").collect())[0] == (1, "POINT (1 2)")
    assert union_agg(same.limit(0), ["k"], "g").count() == 0


def test_outer_joins_number_rows_once(spark):
    """With a key the sides are read as they are; without one a side is numbered in a table, however often it is used."""
    a, b = shapes(spark, 60, 1, "a").repartition(5), shapes(spark, 40, 2, "b")
    boxes = Box("ax0", "ay0", "ax1", "ay1"), Box("bx0", "by0", "bx1", "by1")
    keyed = spatial_join(a, b, "intersects", *boxes, "full", left_key="aid", right_key="bid")
    free = spatial_join(a, b, "intersects", *boxes, "full")
    assert sorted(map(str, keyed.collect())) == sorted(map(str, free.collect())) == sorted(map(str, nested_loop(a, b, "intersects", *boxes, "full").collect()))
    assert all("monotonically_increasing_id" not in x._jdf.queryExecution().executedPlan().toString() for x in (keyed, free))


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(2.57,), (-2.57,)], "x double")
    assert [r[0] for r in df.select(truncate(F.col("x"), 1)).collect()] == [2.5, -2.5]
    assert spark.sql("SELECT 'Brand#12' AS b").where(similar_to(F.col("b"), "Brand#1_")).count() == 1


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(30)]
    spark.createDataFrame(rows, "id long, t string, k string").selectExpr("id", "CAST(t AS TIMESTAMP) AS ts", "k").write.parquet(f"file://{tmp_path}/in")
    batch = spark.read.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    query = windowed_counts(stream, "ts", ["k"], "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, windowed_counts(batch, "ts", ["k"], "10 minutes").collect()))
    assert sorted(map(tuple, spark.table("counted").collect())) == want and len(want) == 6
    assert sessions(batch, "ts", ["k"], "5 minutes").count() == 2
