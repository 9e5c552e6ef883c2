"""The fixture tables of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.geometry import jts
from quadrille.geometry.native import as_wkb, exact
from quadrille.operators.spatial_join import HOW
from quadrille.types import schema

DATA = "I:Integer,L:Long,F:Float,D:Double,B:Boolean,S:String,U:UUID,TS:Timestamp"


def test_data(spark: SparkSession) -> DataFrame:
    """1000 rows; F and D come from decimal text."""
    k = F.col("id")
    tenths = F.concat((k / 10).cast("long"), F.lit("."), k % 10)
    hundredths = F.concat((k / 100).cast("long"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    return spark.range(1000).select(
        F.concat(F.lit("#"), k).alias("__FID__"), k.cast("int").alias("I"), (k + 10000000000).alias("L"), tenths.cast("float").alias("F"), hundredths.cast("double").alias("D"),
        (k % 2 == 0).alias("B"), F.format_string("str%04d", k).alias("S"), F.format_string("00000000-0000-0000-0000-00000000%04d", k).alias("U"), F.timestamp_seconds(k + 1651363200).alias("TS"),
    )


def geom_data(spark: SparkSession) -> DataFrame:
    """121 rows with points of a grid and one geometry of each kind."""
    jts.register(spark)
    ij = spark.range(121).select((F.col("id") / 11).cast("int").alias("i"), (F.col("id") % 11).cast("int").alias("j"))
    wkt = {
        "line": "LINESTRING(0 2, 2 0, 8 6)", "poly": "POLYGON((20 10, 30 0, 40 10, 30 20, 20 10))", "points": "MULTIPOINT(0 0, 2 2)", "lines": "MULTILINESTRING((0 2, 2 0, 8 6),(0 2, 2 0, 8 6))",
        "polys": "MULTIPOLYGON(((-1 0, 0 1, 1 0, 0 -1, -1 0)), ((-2 6, 1 6, 1 3, -2 3, -2 6)), ((-1 5, 2 5, 2 2, -1 2, -1 5)))", "geoms": "GEOMETRYCOLLECTION(POINT(45.0 49.0),POINT(45.1 49.1))",
    }
    return ij.select(
        F.concat(F.lit("#"), "i", F.lit("-"), "j").alias("__FID__"), (F.col("i") + F.col("j")).alias("I"), F.expr("ST_MakePoint(CAST(i AS DOUBLE), CAST(j AS DOUBLE))").alias("pt"),
        *[F.expr(f"ST_GeomFromText('{t}')").alias(n) for n, t in wkt.items()],
    )


def geom_simple(spark: SparkSession) -> DataFrame:
    jts.register(spark)
    lo, hi = "CAST(id - 0.2D AS DOUBLE)", "CAST(id + 0.2D AS DOUBLE)"
    return spark.range(11).select(
        F.concat(F.lit("#"), "id").alias("fid2"), F.col("id").cast("int").alias("I2"), F.expr(f"ST_MakePoint({hi}, {hi})").alias("pt2"),
        F.expr(f"ST_MakeLine(ST_MakePoint({lo}, {lo}), ST_MakePoint({hi}, {hi}))").alias("line2"), F.expr(f"ST_MakeEnvelope({lo}, {lo}, {hi}, {hi})").alias("poly2"),
    )


MODIFY = schema("I:Integer,L:Long,F:Float,D:Double,U:UUID,S:String,B:Boolean,TS:Timestamp,bytes:Bytes,geom:Point")


def modify_rows(spark: SparkSession, n: int) -> DataFrame:
    jts.register(spark)
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("#"), k).alias("__FID__"), k.cast("int").alias("I"), (k + 10000000000).alias("L"), (k * 0.1).cast("float").alias("F"), (k * 0.01).alias("D"),
        F.format_string("00000000-0000-0000-0000-000000000%03d", k).alias("U"), F.format_string("str%03d", k).alias("S"), (k % 2 == 0).alias("B"), F.timestamp_seconds(k + 1600000000).alias("TS"),
        F.expr("X'00010203'").alias("bytes"), F.expr("ST_MakePoint(CAST(id % 90 AS DOUBLE), CAST((id + 1) % 90 AS DOUBLE))").alias("geom"),
    )


def nested_loop(left: DataFrame, right: DataFrame, predicate: str, left_geom, right_geom, how: str = "inner", distance: float | None = None, extra=None) -> DataFrame:
    """A spatial join by comparing all pairs: the yardstick for grid joins."""
    test = exact(predicate, left_geom, right_geom, distance)
    if test is None:
        a, b = as_wkb(left_geom), as_wkb(right_geom)
        test = F.call_function("ST_DWithin", a, b, F.lit(float(distance))) if predicate == "dwithin" else F.call_function("__jts_test", F.lit(predicate), a, b)
    return left.join(right, test if extra is None else test & extra, HOW[how])
