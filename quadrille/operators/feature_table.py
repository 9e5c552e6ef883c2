"""Feature tables on a file system: data files and a log of versions, each the list of the files it consists of.

A change writes new files and then one log entry, whose name is the next number: only one writer can take it, so a
reader sees all of a change or none, and no change is lost. An insert that comes second takes the number after; an
update or delete does so too unless files it has rewritten are gone, which is a conflict. Files are never overwritten,
so a DataFrame of an older version stays readable until ``vacuum`` removes what only old versions need. UPDATE and
DELETE rewrite only the files with rows they hit.

Beside each geometry the files hold its envelope in four plain columns that readers do not see. Spatial searches compare
with them first, which Parquet can prune by.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from quadrille.geometry import jts
from quadrille.geometry.native import Box, Wkb
from quadrille.operators.prefilter import spatial_filter
from quadrille.types import FID, check, with_fid

CORNERS = ("x0", "y0", "x1", "y1")
LOG = "_log"
#: Old versions stay readable for at least this long.
RETAIN_SECONDS = 7 * 86400.0


class ConflictError(RuntimeError):
    """Another writer has replaced rows that this change has read; it may be tried again."""


class Version(NamedTuple):
    number: int
    schema: T.StructType
    files: list[str]


def hidden(geom: str) -> list[str]:
    """Names of the envelope columns of a geometry."""
    return [f"__{geom}_{c}" for c in CORNERS]


class FeatureTable:
    """A typed table with a leading feature id, kept as Parquet below ``path`` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: Version | None = None

    # -- files ---------------------------------------------------------------------------------------------------
    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._p(LOG).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._p(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(LOG) if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one."""
        numbers = self.versions()
        if not numbers or number is not None and number not in numbers:
            raise FileNotFoundError(f"no version {number or ''} of a feature table at {self.path}")
        number = numbers[-1] if number is None else number
        if self._known is None or self._known.number != number:
            stream = self._fs().open(self._p(f"{LOG}/{number:020d}.json"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            entry = json.loads(text)
            self._known = Version(number, T.StructType.fromJson(entry["schema"]), entry["files"])
        return self._known

    def _log(self, entry: Version) -> bool:
        """Write a version beside the log and move it in; false if its number is taken."""
        fs = self._fs()
        new, place = self._p(f"{LOG}/.{uuid.uuid4().hex}"), self._p(f"{LOG}/{entry.number:020d}.json")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"schema": json.loads(entry.schema.json()), "files": entry.files, "time": time.time()}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        flags = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        full = [p.makeQualified(fs.getUri(), fs.getWorkingDirectory()) for p in (new, place)]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(full[0].toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(*full, flags)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        self._known = entry
        return True

    def _commit(self, base: Version, added: list[str], removed: frozenset[str] = frozenset()) -> None:
        """Take the next number with ``added`` in place of ``removed``, on top of whatever others have done meanwhile."""
        while True:
            if not removed <= set(base.files):
                raise ConflictError(f"rows of {self.path} were changed by another writer")
            if self._log(Version(base.number + 1, base.schema, [f for f in base.files if f not in removed] + added)):
                return
            base = self.version()

    def _write(self, rows: DataFrame) -> list[str]:
        folder = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return [f"{folder}/{n}" for n in sorted(self._names(folder)) if n.endswith(".parquet")]

    def vacuum(self, retain_seconds: float = RETAIN_SECONDS) -> int:
        """Delete log entries older than the newest that is ``retain_seconds`` old, and data files that no entry left
        needs and no running change can be about to add; the number of files deleted."""
        fs, numbers = self._fs(), self.versions()
        bound = (time.time() - retain_seconds) * 1000
        old = [n for n in numbers[:-1] if fs.getFileStatus(self._p(f"{LOG}/{numbers[numbers.index(n) + 1]:020d}.json")).getModificationTime() <= bound]
        needed = {f for n in numbers if n not in old for f in self.version(n).files}
        for n in old:
            fs.delete(self._p(f"{LOG}/{n:020d}.json"), False)
        gone = 0
        for folder in (n for n in self._names("") if n.startswith("d-")):
            for s in fs.listStatus(self._p(folder)):
                name = f"{folder}/{s.getPath().getName()}"
                if name.endswith(".parquet") and name not in needed and s.getModificationTime() <= bound:
                    gone += fs.delete(s.getPath(), False)
        return gone

    # -- reading -------------------------------------------------------------------------------------------------
    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame | None = None) -> FeatureTable:
        """A new table, with ``rows`` if given (their ids kept where they have one)."""
        check(schema)
        table = cls(spark, path)
        if table.exists():
            raise ValueError(f"{path} exists")
        stored = T.StructType(schema.fields + [T.StructField(h, T.DoubleType()) for f in schema if "geometry" in f.metadata for h in hidden(f.name)])
        files = [] if rows is None else table._write(table._with_bounds(table._shaped(with_fid(rows), schema)))
        if not table._log(Version(0, stored, files)):
            raise ValueError(f"{path} exists")
        return table

    def stored(self, number: int | None = None, files: list[str] | None = None) -> DataFrame:
        """The files of a version with the hidden envelope columns."""
        now = self.version(number)
        paths = [f"{self.path}/{f}" for f in (now.files if files is None else files)]
        return self.spark.read.schema(now.schema).parquet(*paths) if paths else self.spark.createDataFrame([], now.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one."""
        return _shown(self.stored(number))

    def search(self, geom: str, predicate: str, wkt: str, distance: float | None = None) -> DataFrame:
        """Rows whose geometry column satisfies ``predicate`` against a WKT literal; the scan prunes by envelopes."""
        rows = self.stored()
        return spatial_filter(rows, Wkb(geom), predicate, wkt, distance, Box(*hidden(geom))).select(*_visible(rows.schema))

    def _with_bounds(self, rows: DataFrame) -> DataFrame:
        geometries = [f.name for f in rows.schema if "geometry" in f.metadata]
        if geometries:
            jts.register(self.spark)
        bounds = {h: F.get(F.call_function("__jts_bounds", F.col(g)), F.lit(i)) for g in geometries for i, h in enumerate(hidden(g))}
        return rows.withColumns(bounds) if bounds else rows

    # -- changes -------------------------------------------------------------------------------------------------
    def _shaped(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """``rows`` cast to ``schema`` by column name; columns they lack are null, missing and empty ids are made."""
        names = {c.lower(): c for c in rows.columns}
        if unknown := [c for c in rows.columns if c.lower() not in {f.name.lower() for f in schema}]:
            raise ValueError(f"no columns {unknown} in the table")
        out = []
        for f in schema:
            c = F.col(f"`{names[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)
            if f.name == FID:
                c = F.coalesce(F.when(c != "", c), F.expr("uuid()"))
            out.append(c.alias(f.name, metadata=f.metadata))
        return rows.select(*out)

    def insert(self, rows: DataFrame) -> int:
        """Append rows, cast to the table's types; the number of rows added."""
        base, seen = self.version(), Observation()
        shaped = self._with_bounds(self._shaped(rows, T.StructType([f for f in base.schema if f.name in _visible(base.schema)])))
        files = self._write(shaped.observe(seen, F.count(F.lit(1)).alias("n")))
        n = int(seen.get["n"])
        if n:
            self._commit(base, files)
        return n

    def update(self, values: Mapping[str, Column | str], where: Column | str | None = None, near: Column | None = None) -> int:
        """Set columns to expressions over the old row where ``where`` is true; the number of rows rewritten. ``near``
        is a condition on stored columns that holds of every such row, for the scan to prune by."""
        if any(k.upper() == FID for k in values):
            raise NotImplementedError(f"{FID} cannot be updated")
        names = {c.lower(): c for c in _visible(self.version().schema)}
        if unknown := [k for k in values if k.lower() not in names]:
            raise ValueError(f"no columns {unknown} in the table")
        new = {names[k.lower()]: F.expr(v) if isinstance(v, str) else v for k, v in values.items()}

        def changed(marked: DataFrame, seen: Observation) -> DataFrame:
            old = marked.select(*_visible(marked.schema))
            rows = old.observe(seen, F.count_if("__hit").alias("n")).select(
                *[F.when(F.col("__hit"), new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name, metadata=f.metadata) if f.name in new else F.col(f.name) for f in old.schema if f.name != "__hit"],
            )
            return self._with_bounds(rows)

        return self._rewrite(where, near, changed)

    def delete(self, where: Column | str | None = None, near: Column | None = None) -> int:
        """Remove rows where ``where`` is true; the number of rows removed."""
        return self._rewrite(where, near, lambda marked, seen: marked.observe(seen, F.count_if("__hit").alias("n")).where(~F.col("__hit")).drop("__hit"))

    def _rewrite(self, where: Column | str | None, near: Column | None, changed) -> int:
        base, hit = self.version(), F.coalesce(_condition(where), F.lit(False))
        rows = self.stored(base.number)
        if where is None:
            files = frozenset(base.files)
        else:
            found = (rows if near is None else rows.where(near)).where(hit).select(F.col("_metadata.file_path").alias("f")).distinct() if base.files else None
            ends = {"/".join(r["f"].split("/")[-2:]) for r in found.collect()} if found is not None else set()
            files = frozenset(f for f in base.files if f in ends)
        if not files:
            return 0
        seen = Observation()
        added = self._write(changed(self.stored(base.number, sorted(files)).withColumn("__hit", hit), seen))
        n = int(seen.get["n"])
        if n:
            self._commit(base, added, files)
        return n


def _visible(schema: T.StructType) -> list[str]:
    own = {h for f in schema if "geometry" in f.metadata for h in hidden(f.name)}
    return [f.name for f in schema if f.name not in own]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*_visible(rows.schema))


def _condition(where: Column | str | None) -> Column:
    return F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
