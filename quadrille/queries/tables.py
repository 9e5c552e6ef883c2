"""Feature tables: sources, inserts, updates, deletes and catalog listings, each ending in a query of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.engine import Engine
from quadrille.geometry import jts
from quadrille.operators.feature_table import FeatureTable
from quadrille.queries.spatial import points
from quadrille.shared import new_path
from quadrille.sources import readers
from quadrille.types import schema, with_fid

SPEC = "c_custkey:Long,c_name:String,c_acctbal:Double,share:Float,pt:Point"


def _features(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """An engine with table ``cust``, made from customer with its derived points."""
    engine = Engine(spark)
    jts.register(spark)
    rows = points(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    rows = with_fid(rows, "c_custkey").select("__FID__", "c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") / F.lit(10.0)).alias("share"), F.call_function("ST_MakePoint", "x", "y").alias("pt"))
    path = new_path(spark, "tables")
    engine.register("cust", FeatureTable.create(spark, path, schema(SPEC), rows))
    return engine, path


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _features(spark, sf_dir)
    a = engine.sql("INSERT INTO cust (c_custkey, c_name, pt) VALUES (-1, 'new', ST_GeomFromText('POINT(1 2)')), (-2, NULL, NULL)")
    b = engine.sql("INSERT INTO cust SELECT concat('copy', __FID__), c_custkey + 1000000, c_name, c_acctbal, share, pt FROM cust WHERE c_custkey >= 0")
    out = engine.table("cust").select("c_custkey", "c_name", "c_acctbal", F.call_function("ST_X", "pt").alias("x"))
    return out.withColumns({"a": F.lit(a), "b": F.lit(b)})


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _features(spark, sf_dir)
    n = engine.sql("UPDATE cust SET c_acctbal = c_acctbal + 100, c_name = concat(c_name, '!'), pt = ST_MakePoint(0D, 0D) WHERE mod(c_custkey, 2) = 0")
    return engine.table("cust").select("__FID__", "c_custkey", "c_name", "c_acctbal", F.call_function("ST_AsText", "pt").startswith("POINT (0 0)").alias("moved"), F.lit(n).alias("n"))


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _features(spark, sf_dir)
    n = engine.sql("DELETE FROM cust WHERE mod(c_custkey, 2) <> 0 OR share = 2.6")
    return engine.table("cust").select("c_custkey", F.lit(n).alias("n"))


def dml_update_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _features(spark, sf_dir)
    n = engine.update("cust", {"c_custkey": F.col("c_custkey") + 1000000}, "mod(c_custkey, 2) = 0")
    m = engine.delete("cust", "c_custkey < 1000000")
    return engine.table("cust").select("c_custkey", F.lit(n).alias("n"), F.lit(m).alias("m"))


def catalog_cross_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder under two database names, joined across them."""
    engine = Engine(spark)
    for name in ("db_a", "db_b"):
        engine.attach(name, sf_dir)
    return engine.sql("SELECT a.n_name, b.r_name FROM db_a.nation a, db_b.region b WHERE a.n_regionkey = b.r_regionkey")


def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.attach("store", sf_dir)
    rows = [(t, c, k) for db, t, c, k in engine.columns() if db == "store" and t in ("nation", "customer")]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tables")
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size").write.csv(path, header=True)
    return readers.delimited(spark, path, schema("p_partkey:Long,p_name:String,p_size:Integer"), "p_partkey")


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tables")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    part.write.json(path)
    return readers.json(spark, path, part.schema, "p_partkey")


def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tables")
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand").write.orc(path)
    return readers.orc(spark, path, "p_partkey")


def source_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    jts.register(spark)
    path = new_path(spark, "tables")
    rows = with_fid(points(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey").withColumn("geom", F.call_function("ST_MakePoint", "x", "y"))
    readers.write_geojson(rows.select("__FID__", "c_custkey", "c_name", "geom"), path)
    back = readers.geojson(spark, path, rows.select("c_custkey", "c_name").schema, lines=True)
    return back.select("__FID__", "c_custkey", "c_name", F.call_function("ST_X", "geom").alias("x"))


QUERIES = {f.__name__: f for f in (dml_insert, dml_update, dml_delete, dml_update_then_delete, catalog_cross_database, catalog_describe, source_csv, source_json, source_orc, source_geojson)}

X = "CAST((c_custkey * 37) % 3600 AS DOUBLE) / 10 - 180"
ORACLES = {
    "dml_insert": f"""
        SELECT *, 2 AS a, (SELECT count(*) FROM customer) AS b FROM (
            SELECT c_custkey, c_name, c_acctbal, {X} AS x FROM customer
            UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, {X} FROM customer
            UNION ALL SELECT -1, 'new', NULL, 1 UNION ALL SELECT -2, NULL, NULL, NULL)""",
    "dml_update": """
        SELECT '#' || c_custkey AS "__FID__", c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS c_name,
               CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_custkey % 2 = 0 AS moved,
               (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS n FROM customer""",
    "dml_delete": "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey = 26) AS n FROM customer WHERE c_custkey % 2 = 0 AND c_custkey <> 26",
    "dml_update_then_delete": "SELECT c_custkey + 1000000 AS c_custkey, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS n, (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0) AS m FROM customer WHERE c_custkey % 2 = 0",
    "catalog_cross_database": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "catalog_describe": "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'INTEGER'), ('nation', 'n_name', 'VARCHAR'), ('nation', 'n_regionkey', 'INTEGER'), ('customer', 'c_custkey', 'BIGINT'), ('customer', 'c_name', 'VARCHAR'), ('customer', 'c_nationkey', 'INTEGER'), ('customer', 'c_acctbal', 'DOUBLE'), ('customer', 'c_mktsegment', 'VARCHAR')) AS t(table_name, column_name, kind)",
    "source_csv": "SELECT '#' || p_partkey AS \"__FID__\", p_partkey, p_name, p_size FROM part",
    "source_json": "SELECT '#' || p_partkey AS \"__FID__\", p_partkey, p_size FROM part",
    "source_orc": "SELECT '#' || p_partkey AS \"__FID__\", p_partkey, p_brand FROM part",
    "source_geojson": f"SELECT '#' || c_custkey AS \"__FID__\", c_custkey, c_name, {X} AS x FROM customer",
}
