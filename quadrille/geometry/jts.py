"""JTS operations over WKB, as SQL functions.

``java/Kernel.java`` is compiled against Spark's own jars, which hold JTS, and added to the session when first needed.
The ``ST_`` names are SQL functions over its few entry points, so they are usable from SQL and DataFrames, need no
Python worker, and show up in plans.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from quadrille import compiled

SOURCE = Path(__file__).with_name("java") / "Kernel.java"

#: Java entry points: SQL name -> (class, return type).
ENTRIES = {
    "__jts_test": ("Test", "boolean"),
    "__jts_near": ("Near", "boolean"),
    "__jts_relate": ("Relate", "string"),
    "__jts_relate_to": ("RelateTo", "boolean"),
    "__jts_is": ("Is", "boolean"),
    "__jts_measure": ("Measure", "double"),
    "__jts_between": ("Between", "double"),
    "__jts_count": ("Count", "int"),
    "__jts_text": ("Text", "string"),
    "__jts_read": ("Read", "binary"),
    "__jts_shape": ("Shape", "binary"),
    "__jts_combine": ("Combine", "binary"),
    "__jts_adjust": ("Adjust", "binary"),
    "__jts_point": ("MakePoint", "binary"),
    "__jts_envelope": ("MakeEnvelope", "binary"),
    "__jts_bounds": ("Bounds", "array<double>"),
    "__jts_parts": ("Parts", "array<binary>"),
    "__jts_union_all": ("UnionAll", "binary"),
    "__jts_checked": ("Checked", "binary"),
    # Names that Spark has itself, for types of its own, can only be replaced by Java functions.
    "ST_SRID": ("Srid", "int"),
    "ST_AsBinary": ("Checked", "binary"),
    "ST_GeomFromWKB": ("Checked", "binary"),
}

_G, _GG = "g BINARY", "a BINARY, b BINARY"


def _unary(entry: str, returns: str, names: dict[str, str]) -> dict[str, tuple[str, str, str]]:
    return {sql: (_G, returns, f"{entry}('{op}', g)") for sql, op in names.items()}


def _binary(entry: str, returns: str, names: dict[str, str]) -> dict[str, tuple[str, str, str]]:
    return {sql: (_GG, returns, f"{entry}('{op}', a, b)") for sql, op in names.items()}


def _same(*names: str) -> dict[str, str]:
    return {f"ST_{n}": n.lower() for n in names}


#: ST_ name -> (parameters, return type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    **_binary("__jts_test", "BOOLEAN", _same("Contains", "Within", "Intersects", "Disjoint", "Covers", "CoveredBy", "ContainsProperly", "Crosses", "Overlaps", "Touches", "Equals", "OrderingEquals", "EnvelopesIntersect")),
    "ST_DWithin": (f"{_GG}, d DOUBLE", "BOOLEAN", "__jts_near(a, b, d)"),
    "ST_Relate": (_GG, "STRING", "__jts_relate(a, b)"),
    "ST_RelateTo": (f"{_GG}, pattern STRING", "BOOLEAN", "__jts_relate_to(a, b, pattern)"),
    **_unary("__jts_is", "BOOLEAN", {f"ST_Is{n}": n.lower() for n in ("Empty", "Valid", "Simple", "Rectangle", "Closed", "Ring")}),
    **_unary("__jts_measure", "DOUBLE", _same("Area", "Length", "Perimeter", "XMin", "XMax", "YMin", "YMax", "X", "Y", "Z")),
    **_binary("__jts_between", "DOUBLE", {**_same("Distance", "MaxDistance"), "ST_HausdorffDistance": "hausdorff"}),
    **_unary("__jts_count", "INT", {**_same("Dimension", "CoordDim", "NPoints", "NumGeometries"), "ST_NumPoints": "npoints", "ST_NumInteriorRings": "numinteriorrings", "ST_GeometryTypeCode": "typecode"}),
    **_unary("__jts_text", "STRING", {"ST_AsText": "wkt", "ST_AsWKT": "wkt", "ST_AsEWKT": "ewkt", "ST_AsGeoJson": "geojson", "ST_AsGML": "gml", "ST_GeometryType": "type"}),
    **{
        sql: ("t STRING", "BINARY", f"__jts_read('{op}', t)")
        for sql, op in {
            "ST_GeomFromText": "wkt", "ST_GeomFromWKT": "wkt", "ST_GeomFromEWKT": "ewkt", "ST_GeomFromGeoJson": "geojson", "ST_GeomFromGML": "gml",
            "ST_PointFromText": "wkt", "ST_LineFromText": "wkt", "ST_PolyFromText": "wkt", "ST_MPointFromText": "wkt", "ST_MLineFromText": "wkt", "ST_MPolyFromText": "wkt",
        }.items()
    },
    **_unary("__jts_shape", "BINARY", {
        "ST_Centroid": "centroid", "ST_Envelope": "envelope",
        "ST_Extent": "envelope", "ST_Boundary": "boundary", "ST_ConvexHull": "convexhull", "ST_Normalize": "normalize", "ST_Reverse": "reverse", "ST_FlipCoordinates": "flip",
        "ST_StartPoint": "startpoint", "ST_EndPoint": "endpoint", "ST_ExteriorRing": "exteriorring", "ST_MakePolygon": "makepolygon", "ST_PointOnSurface": "interiorpoint",
        "ST_RemoveHoles": "removeholes", "ST_Holes": "holes", "ST_UnaryUnion": "unaryunion",
    }),
    **{f"ST_{n}": (_G, "BINARY", "__jts_checked(g)") for n in ("AsWKB", "AsEWKB", "GeomFromEWKB")},
    **_binary("__jts_combine", "BINARY", _same("Union", "Intersection", "Difference", "SymDifference", "ClosestPoint", "ShortestLine", "LongestLine", "MakeLine")),
    **{
        f"ST_{n}": ("g BINARY, d DOUBLE", "BINARY", f"__jts_adjust('{op}', g, d, 0D)")
        for n, op in {"Buffer": "buffer", "Simplify": "simplify", "SimplifyPreserveTopology": "simplifytopology", "Densify": "densify", "Rotate": "rotate"}.items()
    },
    "ST_BufferSegments": ("g BINARY, d DOUBLE, n INT", "BINARY", "__jts_adjust('buffer', g, d, CAST(n AS DOUBLE))"),
    **{f"ST_{n}": ("g BINARY, n INT", "BINARY", f"__jts_adjust('{n.lower()}', g, CAST(n AS DOUBLE), 0D)") for n in ("GeometryN", "PointN", "InteriorRingN")},
    **{f"ST_{n}": ("g BINARY, x DOUBLE, y DOUBLE", "BINARY", f"__jts_adjust('{n.lower()}', g, x, y)") for n in ("Translate", "Scale")},
    "ST_Expand": ("g BINARY, d DOUBLE", "BINARY", "__jts_adjust('expand', g, d, d)"),
    "ST_Delaunay": (_G, "BINARY", "__jts_adjust('delaunay', g, 0D, 0D)"),
    "ST_MakePoint": ("x DOUBLE, y DOUBLE", "BINARY", "__jts_point(x, y)"),
    "ST_Point": ("x DOUBLE, y DOUBLE", "BINARY", "__jts_point(x, y)"),
    "ST_MakeEnvelope": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "BINARY", "__jts_envelope(x0, y0, x1, y1)"),
    "ST_Explode": (_G, "ARRAY<BINARY>", "__jts_parts('explode', g, 0D, 0D)"),
    "ST_MakeGrid": ("g BINARY, dx DOUBLE, dy DOUBLE", "ARRAY<BINARY>", "__jts_parts('grid', g, dx, dy)"),
    "ST_MakeGridPoints": ("g BINARY, dx DOUBLE, dy DOUBLE", "ARRAY<BINARY>", "__jts_parts('points', g, dx, dy)"),
    "ST_UnionAll": ("gs ARRAY<BINARY>", "BINARY", "__jts_union_all(gs)"),
}

_done: set[int] = set()


def register(spark: SparkSession) -> SparkSession:
    """Make all ``ST_`` functions available in the session; repeated calls do nothing."""
    mark = hash((spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID()))
    if mark in _done:
        return spark
    compiled.add(spark, SOURCE)
    for name, (cls, returns) in ENTRIES.items():
        spark.udf.registerJavaFunction(name, f"quadrille.Kernel${cls}", returns)
    for name, (params, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    _done.add(mark)
    return spark
