"""Spatial functions, filters and joins over geometry derived from the keys of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.engine import Engine
from quadrille.functions import union_agg
from quadrille.geometry import jts
from quadrille.geometry.native import Box, Point, Wkb, inside
from quadrille.operators.prefilter import spatial_filter
from quadrille.operators.spatial_join import pair_join, spatial_join
from quadrille.streaming import inside_boxes


def _coordinate(key: str, factor: int, modulus: int, shift: float) -> Column:
    return F.pmod(F.col(key) * factor, F.lit(modulus)).cast("double") / F.lit(10.0) - shift


def points(spark: SparkSession, sf_dir: str, table: str, key: str, *keep: str) -> DataFrame:
    """Key, x, y and ``keep`` of one of the tables."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(key, *keep, _coordinate(key, 37, 3600, 180.0).alias("x"), _coordinate(key, 53, 1800, 90.0).alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier boxes: s_suppkey, x0, y0, x1, y1."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    out = df.select("s_suppkey", "s_nationkey", _coordinate("s_suppkey", 97, 3400, 175.0).alias("x0"), _coordinate("s_suppkey", 61, 1700, 88.0).alias("y0"))
    return out.withColumns({"x1": F.col("x0") + 5.0, "y1": F.col("y0") + 5.0})


PT, BX = Point("x", "y"), Box("x0", "y0", "x1", "y1")

CTE = """
    WITH pt AS (
        SELECT *, CAST((c_custkey * 37) % 3600 AS DOUBLE) / 10 - 180 AS x, CAST((c_custkey * 53) % 1800 AS DOUBLE) / 10 - 90 AS y FROM customer
    ), b AS (
        SELECT *, x0 + 5 AS x1, y0 + 5 AS y1 FROM (
            SELECT *, CAST((s_suppkey * 97) % 3400 AS DOUBLE) / 10 - 175 AS x0, CAST((s_suppkey * 61) % 1700 AS DOUBLE) / 10 - 88 AS y0 FROM supplier)
    )
"""


def _customers(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return points(spark, sf_dir, "customer", "c_custkey", *keep)


def _join(predicate: str, how: str, distance: float | None = None, extra: bool = False, wkb: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _customers(spark, sf_dir), boxes(spark, sf_dir)
        lg, rg = PT, Point("x0", "y0") if distance is not None else BX
        if wkb:
            jts.register(spark)
            left = left.withColumn("pt", F.call_function("ST_MakePoint", "x", "y"))
            right = right.withColumn("box", F.call_function("ST_MakeEnvelope", "x0", "y0", "x1", "y1"))
            lg, rg = Wkb("pt"), Wkb("box")
        more = (F.col("c_custkey") + F.col("s_suppkey")) % 2 == 0 if extra else None
        out = spatial_join(left, right, predicate, lg, rg, how, distance, more, left_key="c_custkey", right_key="s_suppkey")
        return out.select("c_custkey") if how in ("left_semi", "left_anti") else out.select("c_custkey", "s_suppkey")

    return run


INSIDE = "b.x0 < pt.x AND pt.x < b.x1 AND b.y0 < pt.y AND pt.y < b.y1"
TOUCH = "b.x0 <= pt.x AND pt.x <= b.x1 AND b.y0 <= pt.y AND pt.y <= b.y1"
NEAR = "sqrt((pt.x - b.x0) * (pt.x - b.x0) + (pt.y - b.y0) * (pt.y - b.y0)) <= 2.5"
PAIR = "SELECT c_custkey, s_suppkey FROM pt {} JOIN b ON {}"


def sp_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inside an envelope, counted by nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    found = _customers(spark, sf_dir, "c_nationkey").where(inside(Box(-50, -30, 50, 30), PT))
    return found.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def sp_filter_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = "POLYGON((-50 -30, 50 -30, 50 30, -50 30, -50 -30))"
    return spatial_filter(_customers(spark, sf_dir), PT, "within", wkt).select("c_custkey")


def sp_filter_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle: the envelope test is native, the exact one JTS."""
    jts.register(spark)
    return spatial_filter(_customers(spark, sf_dir), PT, "intersects", "POLYGON((-100 -50, 100 -50, -100 50, -100 -50))").select("c_custkey")


def sp_filter_dwithin(spark: SparkSession, sf_dir: str) -> DataFrame:
    jts.register(spark)
    return spatial_filter(_customers(spark, sf_dir), PT, "dwithin", "POINT(10 10)", 25.0).select("c_custkey")


def sp_sql_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates by SQL text over WKB."""
    jts.register(spark)
    _customers(spark, sf_dir).createOrReplaceTempView("customer_pt")
    return spark.sql("""
        SELECT c_custkey, ST_Contains(e, p) AS contains, ST_Within(p, e) AS inside, ST_Intersects(e, p) AS meets, ST_Disjoint(e, p) AS apart,
               ST_Covers(e, p) AS covers, ST_Touches(e, p) AS touches, ST_Equals(p, ST_MakePoint(x, y)) AS same, ST_DWithin(p, ST_MakePoint(0D, 0D), 60D) AS near,
               ST_Crosses(p, e) AS crosses, ST_Overlaps(e, e) AS overlaps, ST_EnvelopesIntersect(e, p) AS env
        FROM (SELECT *, ST_MakePoint(x, y) AS p, ST_MakeEnvelope(-50D, -30D, 50D, 30D) AS e FROM customer_pt)""")


def sp_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    jts.register(spark)
    boxes(spark, sf_dir).createOrReplaceTempView("supplier_box")
    return spark.sql("""
        SELECT s_suppkey, ST_Area(g) AS area, ST_Length(g) AS length, ST_Perimeter(g) AS perimeter, ST_XMin(g) AS xmin, ST_XMax(g) AS xmax, ST_YMin(g) AS ymin,
               ST_YMax(g) AS ymax, ST_X(ST_Centroid(g)) AS cx, ST_Y(ST_Centroid(g)) AS cy, ST_NPoints(g) AS npoints, ST_NumGeometries(g) AS parts,
               ST_Dimension(g) AS dim, ST_GeometryType(g) AS kind, ST_IsRectangle(g) AS rect, ST_IsValid(g) AS valid, ST_IsEmpty(g) AS empty, ST_IsSimple(g) AS simple,
               ST_Distance(g, ST_MakePoint(x0 - 3, y0 - 4)) AS dist, ST_SRID(g) AS srid, ST_CoordDim(g) AS cdim
        FROM (SELECT *, ST_MakeEnvelope(x0, y0, x1, y1) AS g FROM supplier_box)""")


def sp_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructive operations on boxes, measured by their areas and bounds."""
    jts.register(spark)
    boxes(spark, sf_dir).createOrReplaceTempView("supplier_box")
    return spark.sql("""
        SELECT s_suppkey, round(ST_Area(ST_Union(g, h)), 6) AS u, round(ST_Area(ST_Intersection(g, h)), 6) AS i, round(ST_Area(ST_Difference(g, h)), 6) AS d,
               round(ST_Area(ST_SymDifference(g, h)), 6) AS s, round(ST_XMin(ST_Translate(g, 10D, 0D)), 6) AS t, round(ST_Area(ST_Scale(g, 2D, 3D)), 6) AS sc,
               round(ST_Area(ST_Expand(g, 1D)), 6) AS ex, round(ST_Area(ST_Envelope(g)), 6) AS en, round(ST_Area(ST_ConvexHull(ST_Union(g, h))), 6) AS ch,
               size(ST_MakeGrid(g, 2.5D, 2.5D)) AS cells, size(ST_Explode(ST_Boundary(g))) AS rings, round(ST_Length(ST_LongestLine(g, g)), 6) AS diag,
               round(ST_XMin(ST_FlipCoordinates(g)), 6) AS flip
        FROM (SELECT *, ST_MakeEnvelope(x0, y0, x1, y1) AS g, ST_MakeEnvelope(x0 + 2, y0 + 1, x1 + 2, y1 + 1) AS h FROM supplier_box)""")


def sp_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    jts.register(spark)
    _customers(spark, sf_dir).createOrReplaceTempView("customer_pt")
    return spark.sql("""
        SELECT c_custkey, ST_X(ST_GeomFromText(ST_AsText(p))) AS x, ST_Y(ST_GeomFromGeoJson(ST_AsGeoJson(p))) AS y, ST_X(ST_GeomFromEWKT(ST_AsEWKT(p))) AS ex,
               ST_Y(ST_GeomFromWKB(ST_AsBinary(p))) AS wy, ST_X(ST_GeomFromGML(ST_AsGML(p))) AS gx
        FROM (SELECT c_custkey, ST_MakePoint(x, y) AS p FROM customer_pt)""")


def sp_union_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area covered by the boxes of each nation, from their union."""
    jts.register(spark)
    g = boxes(spark, sf_dir).withColumn("box", F.call_function("ST_MakeEnvelope", "x0", "y0", "x1", "y1"))
    return union_agg(g, ["s_nationkey"], "box").select("s_nationkey", F.round(F.call_function("ST_Area", "geom"), 4).alias("area"), F.call_function("ST_XMin", "geom").alias("xmin"), F.call_function("ST_YMax", "geom").alias("ymax"))


def sp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of lines and points: the diagonal of each box, once more with its middle, and its corners."""
    jts.register(spark)
    boxes(spark, sf_dir).createOrReplaceTempView("supplier_box")
    return spark.sql("""
        SELECT s_suppkey, ST_X(ST_StartPoint(l)) AS sx, ST_Y(ST_EndPoint(l)) AS ey, ST_X(ST_PointN(l, 2)) AS nx, ST_X(ST_StartPoint(ST_Reverse(l))) AS rx,
               ST_NPoints(ST_Densify(l, 1D)) AS dense, ST_NPoints(ST_Simplify(m, 0.1D)) AS simple, ST_NPoints(ST_SimplifyPreserveTopology(m, 0.1D)) AS kept,
               round(ST_X(ST_Rotate(p, pi())), 6) AS rot, ST_X(ST_ClosestPoint(l, ST_MakePoint(x0 - 1, y0 - 1))) AS close, ST_HausdorffDistance(p, q) AS haus,
               ST_IsClosed(l) AS closed, ST_IsSimple(m) AS plain, ST_Relate(p, p) AS relate, ST_RelateTo(p, q, 'FF*******') AS apart, ST_NumPoints(m) AS points,
               ST_OrderingEquals(l, ST_Reverse(l)) AS ordered, ST_Equals(l, ST_Reverse(l)) AS same, ST_NumGeometries(ST_GeomFromText('MULTIPOINT(0 0, 2 2)')) AS parts,
               ST_X(ST_GeometryN(ST_GeomFromText('MULTIPOINT(0 0, 2 2)'), 2)) AS part, ST_Crosses(l, ST_MakeLine(ST_MakePoint(x0, y1), ST_MakePoint(x1, y0))) AS crosses
        FROM (SELECT *, ST_MakePoint(x0, y0) AS p, ST_MakePoint(x0, y0 + 3) AS q, ST_MakeLine(ST_MakePoint(x0, y0), ST_MakePoint(x1, y1)) AS l,
                     ST_GeomFromText(format_string('LINESTRING(%s %s, %s %s, %s %s)', x0, y0, x0 + 2.5D, y0 + 2.5D, x1, y1)) AS m FROM supplier_box)""")


def sp_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of areas: each box, and the box with a hole of side 1 in its middle."""
    jts.register(spark)
    boxes(spark, sf_dir).createOrReplaceTempView("supplier_box")
    return spark.sql("""
        SELECT s_suppkey, round(ST_Area(ST_Buffer(g, 1D)), 6) AS buffer, round(ST_Area(ST_Buffer(c, 2D)), 6) AS round, round(ST_Length(ST_ShortestLine(g, ST_MakePoint(x0 - 3, y0 - 4))), 6) AS short,
               round(ST_MaxDistance(ST_MakePoint(x0, y0), g), 6) AS far, round(ST_Area(ST_MakePolygon(ST_ExteriorRing(d))), 6) AS filled, ST_IsRing(ST_ExteriorRing(d)) AS ring,
               ST_NumInteriorRings(d) AS rings, round(ST_Area(ST_MakePolygon(ST_InteriorRingN(d, 1))), 6) AS hole, round(ST_Area(ST_RemoveHoles(d)), 6) AS whole, round(ST_Length(ST_Holes(d)), 6) AS holes,
               round(ST_Area(ST_GeometryN(d, 1)), 6) AS first, ST_Equals(ST_Normalize(d), d) AS normal, round(ST_Area(ST_Delaunay(g)), 6) AS triangles, ST_NumGeometries(ST_Delaunay(g)) AS n_triangles,
               size(ST_MakeGridPoints(g, 2.5D, 2.5D)) AS grid, ST_ContainsProperly(g, c) AS proper, ST_ContainsProperly(g, ST_MakePoint(x0, y0)) AS corner, ST_CoveredBy(ST_MakePoint(x0, y0), g) AS covered,
               ST_Contains(d, ST_PointOnSurface(d)) AS on_surface, round(ST_Area(ST_UnaryUnion(d)), 6) AS unary, round(ST_Length(ST_Boundary(d)), 6) AS boundary, ST_GeometryTypeCode(g) AS code,
               ST_AsText(ST_GeomFromWKB(ST_AsWKB(ST_MakePoint(1D, 2D)))) AS text
        FROM (SELECT *, ST_Difference(g, ST_MakeEnvelope(x0 + 2, y0 + 2, x0 + 3, y0 + 3)) AS d FROM
             (SELECT *, ST_MakeEnvelope(x0, y0, x1, y1) AS g, ST_MakePoint(x0 + 2.5D, y0 + 2.5D) AS c FROM supplier_box))""")


def _sql_join(text: str):
    """A join of customers and suppliers by SQL text: c has a point, a line of 5 to the right and a box of 5; s a point, a
    line of 5 upwards and its box."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jts.register(spark)
        make = F.call_function
        c = _customers(spark, sf_dir).select("c_custkey", make("ST_MakePoint", "x", "y").alias("cp"), make("ST_MakeLine", make("ST_MakePoint", "x", "y"), make("ST_MakePoint", F.col("x") + 5, "y")).alias("cl"), make("ST_MakeEnvelope", "x", "y", F.col("x") + 5, F.col("y") + 5).alias("cb"))
        s = boxes(spark, sf_dir).select("s_suppkey", make("ST_MakePoint", "x0", "y0").alias("sp"), make("ST_MakeLine", make("ST_MakePoint", "x0", "y0"), make("ST_MakePoint", "x0", "y1")).alias("sl"), make("ST_MakeEnvelope", "x0", "y0", "x1", "y1").alias("sb"))
        c.createOrReplaceTempView("customer_geo")
        s.createOrReplaceTempView("supplier_geo")
        spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
        points(spark, sf_dir, "events", "event_id").select("event_id", make("ST_MakePoint", "x", "y").alias("ep")).createOrReplaceTempView("event_geo")
        return Engine(spark).sql(text)

    return run


SQL_JOINS = {
    "sp_sql_join_crosses": "SELECT c_custkey, s_suppkey FROM customer_geo c JOIN supplier_geo s ON ST_Crosses(c.cl, s.sl)",
    "sp_sql_join_touches": "SELECT c_custkey, s_suppkey FROM customer_geo c JOIN supplier_geo s ON ST_Touches(c.cb, s.sb)",
    "sp_sql_join_overlaps": "SELECT c_custkey, s_suppkey FROM customer_geo c JOIN supplier_geo s ON ST_Overlaps(c.cb, s.sb)",
    "sp_sql_join_equals": "SELECT c_custkey, event_id FROM customer_geo c JOIN event_geo e ON ST_Equals(c.cp, e.ep)",
    "sp_sql_join_buffer": "SELECT c_custkey, s_suppkey FROM customer_geo c JOIN supplier_geo s ON ST_Contains(ST_Buffer(c.cp, 2.05D), s.sp)",
    "sp_sql_join_cte": "WITH c AS (SELECT * FROM customer_geo WHERE c_custkey % 3 <> 0), s AS (SELECT s_suppkey, sb FROM supplier_geo) SELECT s_suppkey, count(*) AS n FROM c, s WHERE ST_Within(c.cp, s.sb) GROUP BY s_suppkey",
    "sp_sql_join_three": "SELECT c.c_custkey, s.s_suppkey, r.c_name FROM customer_geo c JOIN supplier_geo s ON ST_Within(c.cp, s.sb) JOIN customer r ON r.c_custkey = c.c_custkey",
    "sp_sql_join_derived": "SELECT x.k, count(*) AS n FROM (SELECT s.s_suppkey AS k FROM event_geo e JOIN supplier_geo s ON ST_Within(e.ep, s.sb)) x GROUP BY x.k",
}
MEET = "b.x0 <= x + 5 AND x <= b.x1 AND b.y0 <= y + 5 AND y <= b.y1"
INNER = "b.x0 < x + 5 AND x < b.x1 AND b.y0 < y + 5 AND y < b.y1"


def sp_join_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that overlap other boxes."""
    wide = boxes(spark, sf_dir).select("s_suppkey", (F.col("x0") - 20).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 20).alias("y1"))
    a = wide.toDF("a", "ax0", "ay0", "ax1", "ay1")
    b = wide.withColumnRenamed("s_suppkey", "b")
    return spatial_join(a, b, "intersects", Box("ax0", "ay0", "ax1", "ay1"), BX, extra=F.col("a") < F.col("b")).select("a", "b")


def sp_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial_join(points(spark, sf_dir, "events", "event_id"), boxes(spark, sf_dir), "within", PT, BX)
    return found.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


def sp_stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join that streams use, run as a batch."""
    return inside_boxes(points(spark, sf_dir, "events", "event_id"), boxes(spark, sf_dir), PT, BX, 5.0).select("event_id", "s_suppkey")


def sp_both_sides_operand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate whose operand spans both sides is no grid join: it is tested once for every pair of distinct geometries. Areas are multiples of 0.01, so none is so near the bound that rounding decides."""
    jts.register(spark)
    a = _customers(spark, sf_dir).select("c_custkey", F.call_function("ST_MakePoint", "x", "y").alias("p"))
    b = boxes(spark, sf_dir).select("s_suppkey", F.call_function("ST_MakeEnvelope", "x0", "y0", "x1", "y1").alias("g"))
    return pair_join(a, b, Wkb("p"), Wkb("g"), F.expr("ST_Area(ST_Envelope(ST_Union(p, g))) < 4000.005D")).select("c_custkey", "s_suppkey")


EVENTS = "WITH e AS (SELECT event_id, CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 AS x, CAST((event_id * 53) % 1800 AS DOUBLE) / 10 - 90 AS y FROM events), " + CTE.strip().removeprefix("WITH ")

QUERIES = {
    "sp_flagship": sp_flagship,
    "sp_filter_envelope": sp_filter_envelope,
    "sp_filter_polygon": sp_filter_polygon,
    "sp_filter_dwithin": sp_filter_dwithin,
    "sp_sql_predicates": sp_sql_predicates,
    "sp_accessors": sp_accessors,
    "sp_operations": sp_operations,
    "sp_text_round_trip": sp_text_round_trip,
    "sp_union_agg": sp_union_agg,
    "sp_lines": sp_lines,
    "sp_shapes": sp_shapes,
    **{name: _sql_join(text) for name, text in SQL_JOINS.items()},
    "sp_join_contains": _join("within", "inner"),
    "sp_join_contains_wkb": _join("within", "inner", wkb=True),
    "sp_join_intersects": _join("intersects", "inner"),
    "sp_join_left": _join("within", "left"),
    "sp_join_right": _join("within", "right"),
    "sp_join_full": _join("within", "full"),
    "sp_join_semi": _join("within", "left_semi"),
    "sp_join_anti": _join("within", "left_anti"),
    "sp_join_dwithin": _join("dwithin", "inner", 2.5),
    "sp_join_extra": _join("within", "left", extra=True),
    "sp_join_boxes": sp_join_boxes,
    "sp_join_events": sp_join_events,
    "sp_stream_static": sp_stream_static,
    "sp_both_sides_operand": sp_both_sides_operand,
}

ORACLES = {
    "sp_flagship": CTE + "SELECT n_name, count(*) AS n FROM pt JOIN nation ON c_nationkey = n_nationkey WHERE -50 < x AND x < 50 AND -30 < y AND y < 30 GROUP BY n_name",
    "sp_filter_envelope": CTE + "SELECT c_custkey FROM pt WHERE -50 < x AND x < 50 AND -30 < y AND y < 30",
    "sp_filter_polygon": CTE + "SELECT c_custkey FROM pt WHERE x >= -100 AND y >= -50 AND x + 2 * y <= 0",
    "sp_filter_dwithin": CTE + "SELECT c_custkey FROM pt WHERE sqrt((x - 10) * (x - 10) + (y - 10) * (y - 10)) <= 25",
    "sp_sql_predicates": CTE + """
        SELECT c_custkey, i AS contains, i AS inside, m AS meets, NOT m AS apart, m AS covers, m AND NOT i AS touches, true AS same,
               sqrt(x * x + y * y) <= 60 AS near, false AS crosses, false AS overlaps, m AS env
        FROM (SELECT *, -50 < x AND x < 50 AND -30 < y AND y < 30 AS i, -50 <= x AND x <= 50 AND -30 <= y AND y <= 30 AS m FROM pt)""",
    "sp_accessors": CTE + """
        SELECT s_suppkey, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0) + 2 * (y1 - y0) AS length, 2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter, x0 AS xmin, x1 AS xmax,
               y0 AS ymin, y1 AS ymax, x0 + 2.5 AS cx, y0 + 2.5 AS cy, 5 AS npoints, 1 AS parts, 2 AS dim, 'POLYGON' AS kind, true AS rect, true AS valid,
               false AS empty, true AS simple, CAST(5 AS DOUBLE) AS dist, 0 AS srid, 2 AS cdim
        FROM b""",
    "sp_operations": CTE + """
        SELECT s_suppkey, CAST(38 AS DOUBLE) AS u, CAST(12 AS DOUBLE) AS i, CAST(13 AS DOUBLE) AS d, CAST(26 AS DOUBLE) AS s, round(x0 + 10, 6) AS t,
               CAST(150 AS DOUBLE) AS sc, CAST(49 AS DOUBLE) AS ex, CAST(25 AS DOUBLE) AS en, CAST(40 AS DOUBLE) AS ch, 4 AS cells, 1 AS rings,
               round(sqrt(CAST(50 AS DOUBLE)), 6) AS diag, round(y0, 6) AS flip
        FROM b""",
    "sp_text_round_trip": CTE + "SELECT c_custkey, x, y, x AS ex, y AS wy, x AS gx FROM pt",
    # Boxes begin at multiples of 0.1 and have sides of 5, so a union consists of whole squares of 0.1.
    "sp_union_agg": CTE + """
        SELECT s_nationkey, round(CAST(count(*) AS DOUBLE) / 100, 4) AS area, any_value(xmin) AS xmin, any_value(ymax) AS ymax FROM (
            SELECT DISTINCT s_nationkey, cx, cy, min(x0) OVER n AS xmin, max(y1) OVER n AS ymax
            FROM (SELECT *, unnest(range(CAST(round(x0 * 10) AS BIGINT), CAST(round(x0 * 10) AS BIGINT) + 50)) AS cx FROM b), range(50) AS r(k), LATERAL (SELECT CAST(round(y0 * 10) AS BIGINT) + k AS cy)
            WINDOW n AS (PARTITION BY s_nationkey)) GROUP BY s_nationkey""",
    "sp_lines": CTE + """
        SELECT s_suppkey, x0 AS sx, y1 AS ey, x1 AS nx, x1 AS rx, 9 AS dense, 2 AS simple, 2 AS kept, round(-x0, 6) AS rot, x0 AS close, (y0 + 3) - y0 AS haus, false AS closed, true AS plain,
               '0FFFFFFF2' AS relate, true AS apart, 3 AS points, false AS ordered, true AS same, 2 AS parts, CAST(2 AS DOUBLE) AS part, true AS crosses FROM b""",
    "sp_shapes": CTE + """
        SELECT s_suppkey, round(45 + 16 * sin(pi() / 16), 6) AS buffer, round(64 * sin(pi() / 16), 6) AS round, CAST(5 AS DOUBLE) AS short, round(sqrt(CAST(50 AS DOUBLE)), 6) AS far,
               CAST(25 AS DOUBLE) AS filled, true AS ring, 1 AS rings, CAST(1 AS DOUBLE) AS hole, CAST(25 AS DOUBLE) AS whole, CAST(4 AS DOUBLE) AS holes, CAST(24 AS DOUBLE) AS first,
               true AS normal, CAST(25 AS DOUBLE) AS triangles, 2 AS n_triangles, 4 AS grid, true AS proper, false AS corner, true AS covered, true AS on_surface,
               CAST(24 AS DOUBLE) AS unary, CAST(24 AS DOUBLE) AS boundary, 3 AS code, 'POINT (1 2)' AS text FROM b""",
    "sp_sql_join_crosses": CTE + PAIR.format("", "pt.x < b.x0 AND b.x0 < pt.x + 5 AND b.y0 < pt.y AND pt.y < b.y1"),
    "sp_sql_join_touches": CTE + PAIR.format("", f"{MEET} AND NOT ({INNER})"),
    "sp_sql_join_overlaps": CTE + PAIR.format("", f"{INNER} AND NOT (x = x0 AND y = y0)"),
    "sp_sql_join_equals": EVENTS + "SELECT c_custkey, event_id FROM pt JOIN e ON pt.x = e.x AND pt.y = e.y",
    # A buffer of a point is a polygon of 32 sides.
    "sp_sql_join_buffer": CTE + PAIR.format("", "abs(x0 - x) <= 2.05 AND abs(y0 - y) <= 2.05 AND list_max(list_transform(range(32), lambda k: (x0 - x) * cos((k + 0.5) * pi() / 16) + (y0 - y) * sin((k + 0.5) * pi() / 16))) < 2.05 * cos(pi() / 32)"),
    "sp_sql_join_cte": CTE + f"SELECT s_suppkey, count(*) AS n FROM pt JOIN b ON {INSIDE} WHERE c_custkey % 3 <> 0 GROUP BY s_suppkey",
    "sp_sql_join_three": CTE + f"SELECT c_custkey, s_suppkey, c_name FROM pt JOIN b ON {INSIDE}",
    "sp_sql_join_derived": EVENTS + "SELECT s_suppkey AS k, count(*) AS n FROM e JOIN b ON b.x0 < e.x AND e.x < b.x1 AND b.y0 < e.y AND e.y < b.y1 GROUP BY s_suppkey",
    "sp_join_contains": CTE + PAIR.format("", INSIDE),
    "sp_join_contains_wkb": CTE + PAIR.format("", INSIDE),
    "sp_join_intersects": CTE + PAIR.format("", TOUCH),
    "sp_join_left": CTE + PAIR.format("LEFT", INSIDE),
    "sp_join_right": CTE + PAIR.format("RIGHT", INSIDE),
    "sp_join_full": CTE + PAIR.format("FULL", INSIDE),
    "sp_join_semi": CTE + f"SELECT c_custkey FROM pt WHERE EXISTS (SELECT 1 FROM b WHERE {INSIDE})",
    "sp_join_anti": CTE + f"SELECT c_custkey FROM pt WHERE NOT EXISTS (SELECT 1 FROM b WHERE {INSIDE})",
    "sp_join_dwithin": CTE + PAIR.format("", NEAR),
    "sp_join_extra": CTE + PAIR.format("LEFT", f"{INSIDE} AND (c_custkey + s_suppkey) % 2 = 0"),
    "sp_join_boxes": CTE + "SELECT p.s_suppkey AS a, q.s_suppkey AS b FROM b p JOIN b q ON p.s_suppkey < q.s_suppkey AND p.x0 - 20 <= q.x1 + 20 AND q.x0 - 20 <= p.x1 + 20 AND p.y0 - 20 <= q.y1 + 20 AND q.y0 - 20 <= p.y1 + 20",
    "sp_join_events": EVENTS + "SELECT s_suppkey, count(*) AS n FROM e JOIN b ON b.x0 < e.x AND e.x < b.x1 AND b.y0 < e.y AND e.y < b.y1 GROUP BY s_suppkey",
    "sp_stream_static": EVENTS + "SELECT event_id, s_suppkey FROM e JOIN b ON b.x0 < e.x AND e.x < b.x1 AND b.y0 < e.y AND e.y < b.y1",
    "sp_both_sides_operand": CTE + "SELECT c_custkey, s_suppkey FROM pt JOIN b ON (greatest(x, x1) - least(x, x0)) * (greatest(y, y1) - least(y, y0)) < CAST(4000.005 AS DOUBLE)",
}
