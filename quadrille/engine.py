"""The engine: catalogs of feature tables, SQL with affected-row counts, and the DataFrame entry points."""

from __future__ import annotations

import contextlib
import json
import re
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from quadrille import compiled
from quadrille.geometry import jts
from quadrille.operators.feature_table import FeatureTable
from quadrille.plans import spatial_sql
from quadrille.plans.literals import Tokens, demote, dialect, find_word, fold_casts, split_top
from quadrille.session import session
from quadrille.sources import readers
from quadrille.types import display_type

SPATIAL = re.compile(r"\b(ST_|__jts_)\w+\s*\(", re.I)
CHANGE = re.compile(r"^\s*(INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+([`\w.]+)(.*)$", re.I | re.S)
DEFAULT = "default"


class Engine:
    """Tables under database names, queried together in one session.

    ``attach`` finds the tables below a folder; ``register`` binds one. Listings of attached folders are read again
    after ``cache_seconds`` (0: always). Feature tables take INSERT, UPDATE and DELETE. The ``ST_`` functions are made
    when a statement or a table first needs them; only then is a Java compiler needed.
    """

    def __init__(self, spark: SparkSession | None = None, cache_seconds: float = 600.0):
        self.spark = spark or session()
        self.cache_seconds = cache_seconds
        self.features: dict[str, FeatureTable] = {}
        self.folders: dict[str, tuple[str, float]] = {}
        self.known: dict[str, list[str]] = {DEFAULT: []}
        self.temporary: set[tuple[str, str]] = set()  # tables that are temporary views, which have no database
        self.current = DEFAULT

    # -- catalog -------------------------------------------------------------------------------------------------
    def attach(self, name: str, path: str) -> list[str]:
        """Register every table below ``path`` in database ``name``: feature tables, Parquet, ORC, CSV and GeoJSON.
        Returns their names."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
        self.folders[name] = (path, time.monotonic())
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            raise FileNotFoundError(f"no data store at {path}")
        for status in fs.listStatus(folder):
            file = status.getPath().getName()
            table, _, kind = file.partition(".")
            full = f"{path.rstrip('/')}/{file}"
            if status.isDirectory() and FeatureTable(self.spark, full).exists():
                self._bind(name, table, FeatureTable(self.spark, full))
            elif kind in ("parquet", "orc"):
                self._view(name, table, f"SELECT * FROM {kind}.`{full}`")
            elif kind == "csv":
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `__{name}_{table}` USING csv OPTIONS (path '{full}', header 'true', inferSchema 'true')")
                self._note(name, table)
                self.temporary.add((name, table))
            elif kind in ("geojson", "geojsonl"):
                readers.geojson(self.spark, full, lines=kind == "geojsonl").createOrReplaceTempView(f"__{name}_{table}")
                self._note(name, table)
                self.temporary.add((name, table))
        return self.tables(name)

    def _note(self, db: str, table: str) -> None:
        names = self.known.setdefault(db, [])
        if table not in names:
            names.append(table)

    def _view(self, db: str, table: str, query: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`{table}` AS {query}")
        self._note(db, table)

    def _bind(self, db: str, table: str, feature: FeatureTable) -> None:
        self.features[f"{db}.{table}".lower()] = feature
        self._refresh(f"{db}.{table}".lower())
        self._note(db, table)

    def _refresh(self, name: str) -> None:
        """Point the names of a feature table at its newest version."""
        db, table = name.split(".")
        rows = self.features[name].read()
        if db == DEFAULT:
            rows.createOrReplaceTempView(table)
            return
        rows.createOrReplaceTempView(f"__{db}_{table}")
        self.temporary.add((db, table))
        if db == self.current:
            rows.createOrReplaceTempView(table)

    def use(self, db: str) -> None:
        """Let plain names mean the tables of ``db``."""
        self.spark.catalog.setCurrentDatabase(db)
        self.current = db.lower()
        for name, table in self.temporary:
            if name.lower() == self.current:
                self.spark.table(f"__{name}_{table}").createOrReplaceTempView(table)

    def register(self, name: str, source: str | DataFrame | FeatureTable, options: Mapping[str, str] | None = None) -> None:
        """Bind one table without discovery: a DataFrame, a feature table, or the path of Parquet data or of one.

        Option ``tableType`` is ``translatable`` or ``scannable``: the latter is read whole and read only, as a yardstick
        for the plans of the former. Others mean nothing here."""
        kind = (options or {}).get("tableType", "translatable")
        if kind not in ("translatable", "scannable"):
            raise ValueError(f"tableType {kind} is neither translatable nor scannable")
        db, _, table = name.rpartition(".")
        if isinstance(source, str):
            feature = FeatureTable(self.spark, source)
            source = feature if feature.exists() else self.spark.read.parquet(source)
        if kind == "scannable":  # conditions and aggregates do not pass a filter that is not deterministic
            rows = source.read() if isinstance(source, FeatureTable) else source
            rows.where(F.monotonically_increasing_id() >= 0).createOrReplaceTempView(f"__{db}_{table}" if db else table)
            self._note(db or DEFAULT, table)
            if db:
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
                self.temporary.add((db, table))
            return
        if db:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
        if isinstance(source, FeatureTable):
            self._bind(db or DEFAULT, table, source)
        elif db:
            raise ValueError("a DataFrame has no database: register it by a plain name")
        else:
            source.createOrReplaceTempView(table)
            self._note(DEFAULT, table)

    def tables(self, db: str = DEFAULT) -> list[str]:
        path, when = self.folders.get(db, ("", 0.0))
        if path and self.cache_seconds >= 0 and time.monotonic() - when > self.cache_seconds:
            self.attach(db, path)
        return sorted(self.known.get(db, []))

    def describe(self, name: str) -> list[tuple[str, str]]:
        """Columns with their SQL type names."""
        return [(f.name, display_type(f)) for f in self.table(name).schema]

    def columns(self) -> list[tuple[str, str, str, str]]:
        """All columns of all tables: database, table, column, type."""
        return [(db, t, c, k) for db in self.known for t in self.tables(db) for c, k in self.describe(f"{db}.{t}" if db != DEFAULT else t)]

    def table(self, name: str) -> DataFrame:
        feature = self._feature(name)
        rows = feature.read() if feature else self.spark.table(self._resolved(name))
        if any(isinstance(f.dataType, BinaryType) for f in rows.schema):  # callers may apply ST_ functions to it
            with contextlib.suppress(compiled.CompilerMissing):
                jts.register(self.spark)
        return rows

    def _feature(self, name: str) -> FeatureTable | None:
        plain = re.sub(r"[`\s]", "", name).lower()
        names = [plain] if "." in plain else [f"{self.current}.{plain}", f"{DEFAULT}.{plain}"]
        return next((self.features[n] for n in names if n in self.features), None)

    def _resolved(self, name: str) -> str:
        """The name of the temporary view that stands for a table, or ``name``."""
        db, _, table = re.sub(r"[`\s]", "", name).lower().rpartition(".")
        return next((f"__{d}_{t}" for d, t in self.temporary if (d.lower(), t.lower()) == (db, table)), name)

    def _renamed(self, text: str) -> str:
        """``text`` with names of tables that are temporary views in their place; literals stay as they are."""
        tokens = Tokens.of(text)
        solid = tokens.solid()
        for j, i in enumerate(solid):
            kind, t = tokens[i]
            if kind == "quoted" and j + 2 < len(solid) and tokens[solid[j + 1]][1] == ".":  # `db`.`table`
                whole = "".join(tokens[k][1] for k in range(i, solid[j + 2] + 1))
                if (new := self._resolved(whole)) != whole:
                    tokens[i][1] = new
                    for k in range(i + 1, solid[j + 2] + 1):
                        tokens[k][1] = ""
            elif kind == "word" and "." in t:
                parts = re.split(r"\s*\.\s*", t)
                if (new := self._resolved(".".join(parts[:2]))) != ".".join(parts[:2]):
                    tokens[i][1] = ".".join([new, *parts[2:]])
        return tokens.text()

    # -- SQL -----------------------------------------------------------------------------------------------------
    def sql(self, text: str, args: Sequence | Mapping | None = None) -> DataFrame | int:
        """A query's DataFrame, or the number of affected rows of INSERT, UPDATE or DELETE. ``?`` and ``:name`` stand
        for ``args``."""
        text = fold_casts(dialect(text))
        if SPATIAL.search(text):
            jts.register(self.spark)
        if change := CHANGE.match(text):
            return self._change(re.sub(r"\s+", " ", change[1].upper()), change[2], change[3].strip())
        if args and SPATIAL.search(text) and (bound := spatial_sql.bind(text, args)) is not None:
            text, args = bound, None
        self._refuse(text)
        text = demote(text, self._floats(text))
        text = self._renamed(spatial_sql.prune(self.spark, text, self._feature))
        if args is None and (joined := spatial_sql.rewrite(self.spark, text)) is not None:
            return joined
        return self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)

    def _refuse(self, text: str) -> None:
        """MIN and MAX of a geometry column mean nothing: geometries have no order."""
        tokens = Tokens.of(text)
        at = tokens.solid()
        words = [tokens[i][1] for i in at]
        asked = {words[j + 2].split(".")[-1].strip("` ").lower() for j in range(len(words) - 3) if words[j].upper() in ("MIN", "MAX") and words[j + 1] == "(" and words[j + 3] == ")"}
        named = {w.lower() for w in re.findall(r"\w+", text)}
        for name, feature in self.features.items() if asked else ():
            if name.split(".")[1] in named:
                if bad := [f.name for f in feature.version().schema if "geometry" in f.metadata and f.name.lower() in asked]:
                    raise TypeError(f"MIN and MAX do not apply to geometry {bad[0]}")

    def _floats(self, text: str) -> set[str]:
        """Columns that are FLOAT, and nothing else, in the tables the text names."""
        words = {w.lower() for w in re.findall(r"\w+", text)}
        kinds: dict[str, set[str]] = {}
        for db, names in self.known.items():
            for t in names:
                if t.lower() in words or f"__{db}_{t}".lower() in words:
                    for f in self.table(f"{db}.{t}" if db != DEFAULT else t).schema:
                        kinds.setdefault(f.name.lower(), set()).add(f.dataType.simpleString())
        return {c for c, k in kinds.items() if k == {"float"}}

    def _change(self, verb: str, name: str, rest: str) -> int:
        feature = self._feature(name)
        if verb == "MERGE INTO":
            raise NotImplementedError("MERGE is not supported")
        if feature is None:
            raise ValueError(f"{name} is not a feature table")
        floats = {f.name for f in feature.read().schema if f.dataType.simpleString() == "float"}
        if verb == "INSERT INTO":
            n = feature.insert(self._rows(feature, self._renamed(rest)))
        else:
            cut = find_word(rest, "WHERE")
            where = demote(rest[cut + 5 :].strip(), floats) if cut >= 0 else None
            near = spatial_sql.envelope(self.spark, where, feature) if where else None
            if verb == "UPDATE":
                body = rest[: cut if cut >= 0 else len(rest)].strip()
                if not re.match(r"SET\b", body, re.I):
                    raise ValueError("UPDATE needs SET")
                pairs = (p.split("=", 1) for p in split_top(body[3:].strip()))
                n = feature.update({k.strip().strip("`"): v.strip() for k, v in pairs}, where, near)
            else:
                n = feature.delete(where, near)
        return self._done(name, n)

    def _rows(self, feature: FeatureTable, rest: str) -> DataFrame:
        listed = re.match(r"\(((?:[^()'])*)\)\s*(?=SELECT\b|VALUES\b|WITH\b)", rest, re.I)
        names = [c.strip().strip("`") for c in listed[1].split(",")] if listed else feature.read().columns
        query = (rest[listed.end() :] if listed else rest).strip()
        if re.match(r"VALUES\b", query, re.I):  # Spark's inline tables take no functions that are not its own
            query = " UNION ALL ".join("SELECT " + row.strip()[1:-1] for row in split_top(query[6:]))
        rows = self.spark.sql(query)
        if len(rows.columns) != len(names):
            raise ValueError(f"{len(rows.columns)} values for {len(names)} columns")
        return rows.toDF(*names)

    def explain(self, query: str | DataFrame, mode: str = "formatted") -> str:
        """The plan as text; nothing runs."""
        df = self.sql(query) if isinstance(query, str) else query
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # -- DataFrames ----------------------------------------------------------------------------------------------
    def insert(self, name: str, rows: DataFrame) -> int:
        return self._done(name, self._need(name).insert(rows))

    def update(self, name: str, values: Mapping[str, Column | str], where: Column | str | None = None) -> int:
        return self._done(name, self._need(name).update(values, where))

    def delete(self, name: str, where: Column | str | None = None) -> int:
        return self._done(name, self._need(name).delete(where))

    def _need(self, name: str) -> FeatureTable:
        if feature := self._feature(name):
            return feature
        raise ValueError(f"{name} is not a feature table")

    def _done(self, name: str, n: int) -> int:
        feature = self._need(name)
        for known, table in self.features.items():
            if table.path == feature.path:
                self._refresh(known)
        return n

    def cancel(self, tag: str) -> None:
        """Stop the running jobs that were started under ``spark.addTag(tag)``."""
        self.spark.interruptTag(tag)


def connect(stores: Mapping[str, str] | None = None, spark: SparkSession | None = None, cache_seconds: float = 600.0) -> Engine:
    """An engine with each store (database name -> folder) attached."""
    engine = Engine(spark, cache_seconds)
    for name, path in (stores or {}).items():
        engine.attach(name, path)
    return engine


def connect_model(path: str, spark: SparkSession | None = None) -> Engine:
    """An engine as a model file (JSON, or YAML where PyYAML is installed) describes it.

    ``schemas`` lists databases: ``name``, an ``operand`` with the ``path`` of a folder to attach and perhaps
    ``schemaCacheExpireSeconds``, and ``tables``, each with a ``name`` and an ``operand`` of ``path`` and options.
    Plain names mean the tables of ``defaultSchema``.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        model = json.loads(text)
    else:
        import yaml

        model = yaml.safe_load(text)
    engine = Engine(spark)
    for schema in model.get("schemas", []):
        operand = schema.get("operand", {})
        engine.cache_seconds = float(operand.get("schemaCacheExpireSeconds", engine.cache_seconds))
        if "path" in operand:
            engine.attach(schema["name"], operand["path"])
        for table in schema.get("tables", []):
            given = table.get("operand", {})
            if "path" not in given:
                raise ValueError(f"table {table['name']} needs a path")
            feature = FeatureTable(engine.spark, given["path"])
            kind = given.get("tableType", "translatable")
            if kind == "translatable" and not feature.exists():
                engine.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema['name']}`")
                engine._view(schema["name"], table["name"], f"SELECT * FROM parquet.`{given['path']}`")
            else:
                engine.register(f"{schema['name']}.{table['name']}", given["path"], given)
    if "defaultSchema" in model:
        engine.use(model["defaultSchema"])
    return engine
