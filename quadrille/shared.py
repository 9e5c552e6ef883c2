"""Tables in the folder that all executors share, to cut lineage, fix row numbers and reuse results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local one is made in local mode, as in tests; on a
    cluster, whose executors would not share it, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _fallback.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quadrille-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the driver's Python ends, or by ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: any executor may be lost afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrille_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any longer."""
    for df in frames:
        if path := getattr(df, "_quadrille_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
