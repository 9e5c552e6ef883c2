"""Bounding-box prefilters for spatial predicates against a constant geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.geometry import jts
from quadrille.geometry.native import Box, Geometry, as_wkb, exact


def constant_bounds(df: DataFrame, wkt: str) -> tuple[bytes, Box]:
    """WKB and envelope of a WKT literal, worked out once on the driver."""
    jvm = df.sparkSession.sparkContext._jvm
    g = jvm.org.locationtech.jts.io.WKTReader().read(wkt)
    e = g.getEnvelopeInternal()
    return bytes(jvm.org.locationtech.jts.io.WKBWriter(2, 2).write(g)), Box(e.getMinX(), e.getMinY(), e.getMaxX(), e.getMaxY())


def spatial_filter(df: DataFrame, geom: Geometry, predicate: str, wkt: str, distance: float | None = None, bounds: Box | None = None) -> DataFrame:
    """Rows whose geometry satisfies ``predicate`` (geometry first) against a WKT literal.

    Plain comparisons with the literal's envelope come first: on stored coordinate columns they reach the Parquet scan.
    ``bounds`` names columns with the envelopes of the geometries, where there are some beside them. Where the literal is a rectangle and the rows are points or boxes they are all there is.
    """
    wkb, box = constant_bounds(df, wkt)
    grow = float(distance or 0.0)
    x0, y0, x1, y1 = (bounds or geom).bounds()
    b = (box.xmin - grow, box.ymin - grow, box.xmax + grow, box.ymax + grow)
    near = (x1 >= b[0]) & (x0 <= b[2]) & (y1 >= b[1]) & (y0 <= b[3])
    rectangle = df.sparkSession.sparkContext._jvm.org.locationtech.jts.io.WKTReader().read(wkt).isRectangle()
    test: Column | None = exact(predicate, geom, box, distance) if rectangle else None
    if test is None:
        jts.register(df.sparkSession)
        lit = F.lit(wkb)
        test = F.call_function("ST_DWithin", as_wkb(geom), lit, F.lit(grow)) if predicate == "dwithin" else F.call_function("__jts_test", F.lit(predicate), as_wkb(geom), lit)
    return df.where(test) if predicate == "disjoint" else df.where(near & test)
