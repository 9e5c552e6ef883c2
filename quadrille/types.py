"""Types of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FID = "__FID__"
GEOMETRIES = ("Geometry", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
#: Attribute type -> Spark type.
TYPES: dict[str, T.DataType] = {
    "String": T.StringType(), "Integer": T.IntegerType(), "Double": T.DoubleType(), "Long": T.LongType(), "Float": T.FloatType(),
    "Boolean": T.BooleanType(), "UUID": T.StringType(), "Date": T.TimestampType(), "Timestamp": T.TimestampType(), "Bytes": T.BinaryType(),
    **{g: T.BinaryType() for g in GEOMETRIES},
}
STORED = (T.StringType, T.IntegerType, T.DoubleType, T.LongType, T.FloatType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


class UnsupportedTypeError(TypeError):
    """A column type that feature tables do not store."""


def schema(spec: str, srid: int = 4326) -> T.StructType:
    """A schema from ``name:Type,...``. The feature id comes first, every column may be null, geometries are WKB and
    carry their subtype and SRID as metadata."""
    fields = [T.StructField(FID, T.StringType())]
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, kind = part.lstrip("*").partition(":")
        if kind not in TYPES:
            raise UnsupportedTypeError(f"{name}: {kind or 'no type'} is not an attribute type")
        fields.append(T.StructField(name, TYPES[kind], True, {"geometry": kind, "srid": srid} if kind in GEOMETRIES else {}))
    return T.StructType(fields)


def check(s: T.StructType) -> None:
    for f in s.fields:
        if not isinstance(f.dataType, STORED):
            raise UnsupportedTypeError(f"{f.name}: {f.dataType.simpleString()} is not stored in feature tables")


def with_fid(df: DataFrame, fid: Column | str | None = None) -> DataFrame:
    """``df`` with the feature id as its first column: the column ``__FID__`` if there is one, else ``fid`` after a
    number sign, else a random UUID."""
    if FID in df.columns:
        return df.select(FID, *[c for c in df.columns if c != FID])
    new = F.expr("uuid()") if fid is None else F.concat(F.lit("#"), (F.col(fid) if isinstance(fid, str) else fid).cast("string"))
    return df.select(new.alias(FID), "*")


def display_type(f: T.StructField) -> str:
    """The SQL type name shown by describe."""
    if kind := f.metadata.get("geometry"):
        return f"GEOMETRY({kind})"
    names = {"string": "VARCHAR", "int": "INTEGER", "float": "REAL", "binary": "VARBINARY", "timestamp_ntz": "TIMESTAMP"}
    return names.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
