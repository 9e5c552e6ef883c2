"""Readers that give DataFrames with a leading feature id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quadrille.geometry import jts
from quadrille.types import FID, with_fid


def parquet(spark: SparkSession, path: str, fid: str | None = None) -> DataFrame:
    return with_fid(spark.read.parquet(path), fid) if fid else spark.read.parquet(path)


def orc(spark: SparkSession, path: str, fid: str | None = None) -> DataFrame:
    return with_fid(spark.read.orc(path), fid) if fid else spark.read.orc(path)


def json(spark: SparkSession, path: str, schema: T.StructType, fid: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return with_fid(df, fid) if fid else df


def delimited(spark: SparkSession, path: str, schema: T.StructType, fid: str | None = None, header: bool = True, separator: str = ",", skip_bad: bool = True) -> DataFrame:
    """Delimited text with typed columns. ``schema`` may start with the feature id: it is then ``#`` and column
    ``fid``. Records that do not fit the types are dropped with ``skip_bad``, else they fail the read."""
    own = T.StructType([f for f in schema.fields if f.name != FID])
    df = spark.read.csv(path, schema=own, header=header, sep=separator, mode="DROPMALFORMED" if skip_bad else "FAILFAST", enforceSchema=True)
    return with_fid(df, fid) if fid else df


def geojson(spark: SparkSession, path: str, properties: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Features of GeoJSON collections (or, with ``lines``, one feature a line): feature id, properties, geom (WKB).

    Without a schema for ``properties`` Spark infers them. Ids come from the features where they have one. Geometry
    objects are kept as JSON text until JTS reads them, so all geometry types are covered.
    """
    jts.register(spark)
    text = spark.read.text(path, wholetext=not lines)
    feature = "struct<type:string,id:string,properties:string,geometry:string>"
    if lines:
        rows = text.select(F.from_json("value", feature).alias("f"))
    else:
        rows = text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    if properties is None:
        inferred = spark.read.option("multiLine", not lines).json(path).schema
        feature_type = inferred if lines else inferred["features"].dataType.elementType
        properties = feature_type["properties"].dataType
    made = rows.select(F.coalesce("f.id", F.expr("uuid()")).alias(FID), F.from_json("f.properties", properties).alias("p"), F.call_function("__jts_read", F.lit("geojson"), F.col("f.geometry")).alias("geom"))
    return made.select(FID, "p.*", "geom")


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """One GeoJSON feature a line, in as many files as ``df`` has partitions."""
    jts.register(df.sparkSession)
    plain = [c for c in df.columns if c not in (geom, FID)]
    feature = F.concat(
        F.lit('{"type":"Feature",'),
        F.when(F.col(FID).isNotNull(), F.concat(F.lit('"id":'), F.expr(f"substring(to_json(array(`{FID}`)), 2, length(to_json(array(`{FID}`))) - 2)"), F.lit(","))).otherwise(F.lit("")) if FID in df.columns else F.lit(""),
        F.lit('"properties":'), F.to_json(F.struct(*plain)) if plain else F.lit("{}"),
        F.lit(',"geometry":'), F.coalesce(F.call_function("ST_AsGeoJson", F.col(geom)), F.lit("null")), F.lit("}"),
    )
    df.select(feature.alias("value")).write.text(path)
