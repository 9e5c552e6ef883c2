"""Spatial joins as equi-joins over grid cells, with exact refinement.

The distinct geometries of each side are joined first, so a predicate is tested once for a pair of geometries however many
rows have them; the rows of a pair then meet by equi-joins over numbers of their geometries. Rows of a geometry that very
many have are dealt to chunks, and all joins run in as many tasks as the session shuffles to, whatever the files of a side.

Each envelope is dealt to the grid cells it meets; rows of both sides that share a cell and whose envelopes overlap are
candidates. A pair that shares several cells is kept only in the one that holds the lower left corner of the overlap of
the two envelopes, so no shuffle is needed to drop repeats. Envelopes that meet more than ``most_cells`` cells are dealt
to a coarser grid level instead, so the explosion of a row is bounded whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.geometry import jts
from quadrille.geometry.native import Box, Geometry, Point, Wkb, as_wkb, exact
from quadrille.shared import materialise, release

PREDICATES = ("contains", "within", "intersects", "crosses", "equals", "overlaps", "touches", "covers", "coveredby", "dwithin")
HOW = {"inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right", "full": "full", "outer": "full", "left_semi": "left_semi", "left_anti": "left_anti"}
#: Levels differ by this factor in cell width; there are as many as two levels apart cover any double-precision extent.
LEVEL_FACTOR, LEVELS = 8.0, 12
#: Rows of one geometry are dealt to chunks of about this many.
CHUNK = 2048
#: Nodes of a plan whose rows may differ from one run to the next.
UNSETTLED = ("Limit", "Offset", "Sample", "Deduplicate", "Window")


@dataclass
class _Side:
    """The rows of a side with the number of their geometry, its distinct geometries and figures of them."""

    rows: DataFrame
    shapes: DataFrame
    geom: Geometry
    count: int
    most: int
    average: float
    largest: float
    everything: float
    keys: list[str]


def _settled(df: DataFrame) -> DataFrame:
    """``df``, written in the shared folder if a second run of it might give other rows."""
    plan = df._jdf.queryExecution().analyzed()
    return materialise(df, "join-side") if not plan.deterministic() or any(n in plan.toString() for n in UNSETTLED) else df


def _named(g: Geometry, prefix: str) -> tuple[dict[str, Column], Geometry]:
    """The columns of a geometry under names of their own, and the geometry over these."""
    if isinstance(g, Wkb):
        return {f"{prefix}g": g.column()}, Wkb(f"{prefix}g")
    x0, y0, x1, y1 = g.bounds()
    if isinstance(g, Point):
        return {f"{prefix}g0": x0, f"{prefix}g1": y0}, Point(f"{prefix}g0", f"{prefix}g1")
    names = [f"{prefix}g{i}" for i in range(4)]
    return dict(zip(names, (x0, y0, x1, y1), strict=True)), Box(*names)


def _side(rows: DataFrame, g: Geometry, prefix: str) -> _Side:
    """A geometry's number is a hash of it, taken with another seed if two geometries have the same."""
    values, geom = _named(g, prefix)
    bounds = F.call_function("__jts_bounds", geom.column()) if isinstance(geom, Wkb) else F.array(*[b.cast("double") for b in geom.bounds()])
    number, box = f"{prefix}id", [F.get(f"{prefix}b", F.lit(i)) for i in range(4)]
    w, h = box[2] - box[0], box[3] - box[1]
    for seed in range(8):
        mark = F.xxhash64(F.lit(seed), *values.values()).alias(number)
        found = rows.select(mark, *[v.alias(k) for k, v in values.items()]).groupBy(number, *values).agg(F.count(F.lit(1)).alias(f"{prefix}n"))
        shapes = materialise(found.select("*", bounds.alias(f"{prefix}b")), "join-shapes")
        each = shapes.groupBy(number).agg(
            F.count(F.lit(1)).alias("same"), F.sum(f"{prefix}n").alias("n"), F.max(F.when(box[0].isNotNull(), F.col(f"{prefix}n"))).alias("most"), F.count(w).alias("k"),
            F.sum(w).alias("w"), F.sum(h).alias("h"), F.max(w).alias("mw"), F.max(h).alias("mh"), F.min(box[0]).alias("x0"), F.max(box[2]).alias("x1"))
        row = each.agg(
            F.max("same").alias("same"), F.sum("n").alias("n"), F.max("most").alias("most"), (F.sum("w") / F.sum("k")).alias("w"), (F.sum("h") / F.sum("k")).alias("h"),
            F.max("mw").alias("mw"), F.max("mh").alias("mh"), (F.max("x1") - F.min("x0")).alias("all")).first()
        v = {k: row[k] or 0 for k in row.asDict()}
        if v["same"] <= 1:
            keys = [number, f"{prefix}chunk"] if v["most"] > CHUNK else [number]
            return _Side(rows.select("*", mark), shapes, geom, v["n"], v["most"], float(max(v["w"], v["h"])), float(max(v["mw"], v["mh"])), float(v["all"]), keys)
        release(shapes)
    raise RuntimeError("no hash without collisions was found for the geometries of a side")


def _hashable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def _chunked(side: _Side, prefix: str) -> DataFrame:
    """The rows of a side, with their chunks where a geometry has more rows than one takes."""
    if side.most <= CHUNK:
        return side.rows
    many = side.shapes.where(F.col(f"{prefix}n") > CHUNK).select(f"{prefix}id", F.ceil(F.col(f"{prefix}n") / CHUNK).alias(f"{prefix}chunks"))
    chunk = F.pmod(F.xxhash64(*_hashable(side.rows)), F.coalesce(f"{prefix}chunks", F.lit(1)))
    return side.rows.join(many, f"{prefix}id", "left").withColumn(f"{prefix}chunk", chunk).drop(f"{prefix}chunks")


def tasks(spark: SparkSession) -> int:
    """How many tasks a join is spread over, however few files or bytes its sides have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def _rows(pairs: DataFrame, a: _Side, b: _Side) -> DataFrame:
    """All rows of each pair of geometries, given by their numbers and counts; the side of fewer rows is joined first."""
    n = tasks(pairs.sparkSession)
    for side, prefix in ((a, "__a"), (b, "__b")):
        if side.most > CHUNK:
            pairs = pairs.withColumn(f"{prefix}chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"{prefix}n") / CHUNK) - 1)))
    out = pairs.drop("__an", "__bn")
    for side, prefix in sorted(((a, "__a"), (b, "__b")), key=lambda s: s[0].count):
        out = _chunked(side, prefix).repartition(n, *side.keys).join(out.repartition(n, *side.keys), side.keys)
    return out.drop(*a.keys, *b.keys)


def pair_join(left: DataFrame, right: DataFrame, left_geom: Wkb, right_geom: Wkb, condition: Column) -> DataFrame:
    """Join where ``condition``, over the columns of the two geometries and no others, is true. It may take both at once, so
    every pair of distinct geometries is tested, once, in as many tasks as other joins have."""
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    jts.register(left.sparkSession)
    a, b = _side(_settled(left), left_geom, "__a"), _side(_settled(right), right_geom, "__b")
    shapes = [s.shapes.withColumnRenamed(f"{p}g", g.geom).drop(f"{p}b") for s, g, p in ((a, left_geom, "__a"), (b, right_geom, "__b"))]
    pairs = shapes[0].repartition(tasks(left.sparkSession)).crossJoin(shapes[1]).where(condition)
    return _rows(pairs.select("__aid", "__an", "__bid", "__bn"), a, b).select(*left.columns, *right.columns)


def _cells(df: DataFrame, bounds: tuple[Column, Column, Column, Column], size: float, within: float, most_cells: int, top: int, prefix: str) -> DataFrame:
    """``df`` with envelope columns and its level, the finest at which the envelope meets ``most_cells`` at most."""
    x0, y0, x1, y1 = bounds
    out = df.select("*", (x0 - within).alias(f"{prefix}x0"), (y0 - within).alias(f"{prefix}y0"), (x1 + within).alias(f"{prefix}x1"), (y1 + within).alias(f"{prefix}y1"))
    level = F.lit(top)
    for k in reversed(range(top)):
        w = size * LEVEL_FACTOR**k
        n = (F.floor(F.col(f"{prefix}x1") / w) - F.floor(F.col(f"{prefix}x0") / w) + 1.0) * (F.floor(F.col(f"{prefix}y1") / w) - F.floor(F.col(f"{prefix}y0") / w) + 1.0)
        level = F.when(n <= most_cells, F.lit(k)).otherwise(level)
    return out.where(F.col(f"{prefix}x0").isNotNull() & F.col(f"{prefix}y0").isNotNull()).withColumn(f"{prefix}level", level)


def _dealt(df: DataFrame, size: float, prefix: str, level: Column, single: bool) -> DataFrame:
    """``df`` with its cells; ``single`` where an envelope is a point and so meets just one."""
    w = F.lit(size) * F.pow(F.lit(LEVEL_FACTOR), level)
    if single:
        return df.withColumns({"__lv": level, "__cx": F.floor(F.col(prefix + "x0") / w), "__cy": F.floor(F.col(prefix + "y0") / w)})

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(prefix + lo) / w), F.floor(F.col(prefix + hi) / w))

    out = df.withColumn("__lv", level).withColumn("__cx", F.explode(span("x0", "x1")))
    return out.withColumn("__cy", F.explode(span("y0", "y1")))


def _top_level(largest: float, size: float, most_cells: int) -> int:
    """The level at which an envelope with sides of ``largest`` meets ``most_cells`` cells at most."""
    return next((k for k in range(LEVELS - 1) if (largest / (size * LEVEL_FACTOR**k) + 2) ** 2 <= most_cells), LEVELS - 1)


def _numbered(df: DataFrame, key: str | None, name: str) -> DataFrame:
    return df.select("*", F.col(key).alias(name)) if key else materialise(df.select("*", F.monotonically_increasing_id().alias(name)), "join-side")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: str,
    left_geom: Geometry,
    right_geom: Geometry,
    how: str = "inner",
    distance: float | None = None,
    extra: Column | None = None,
    size: float | None = None,
    most_cells: int = 64,
    left_key: str | None = None,
    right_key: str | None = None,
) -> DataFrame:
    """Join ``left`` and ``right`` where ``predicate`` holds of their geometries and ``extra`` is true.

    ``predicate`` is one of ``PREDICATES``; dwithin takes ``distance``. Geometries are ``Point``, ``Box`` or ``Wkb``
    over each side's columns; pairs of points and boxes need no JTS. Column names of the two sides must differ. Rows
    with a null or empty geometry match nothing and stay in outer joins. ``size`` is the finest grid width, by default
    from the average envelope of the right side's distinct geometries. Outer, semi and anti joins tell rows by ``left_key`` and ``right_key``,
    columns that are unique and not null; a side without one is numbered and written in the shared folder first, so that
    a row has the same number wherever it is used.
    """
    kind = HOW.get(how)
    if predicate not in PREDICATES or kind is None:
        raise ValueError(f"unknown predicate {predicate!r} or join type {how!r}")
    if (predicate == "dwithin") != (distance is not None):
        raise ValueError("dwithin takes a distance, and only dwithin does")
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    within = float(distance or 0.0)
    outer = kind != "inner"
    if isinstance(left_geom, Wkb) or isinstance(right_geom, Wkb):
        jts.register(left.sparkSession)
    lrows = _numbered(left, left_key, "__l") if outer else left
    rrows = _numbered(right, right_key, "__r") if kind in ("left", "right", "full") else right
    lside, rside = _side(_settled(lrows), left_geom, "__a"), _side(_settled(rrows), right_geom, "__b")
    size = size or max(rside.average, 2 * within) or max(rside.everything / 256, 1e-6)
    top = _top_level(max(lside.largest + 2 * within, rside.largest), size, most_cells)
    test = exact(predicate, lside.geom, rside.geom, distance)
    if test is None:
        jts.register(left.sparkSession)
        a, b = as_wkb(lside.geom), as_wkb(rside.geom)
        test = F.call_function("ST_DWithin", a, b, F.lit(within)) if predicate == "dwithin" else F.call_function("__jts_test", F.lit(predicate), a, b)
    a = _cells(lside.shapes, tuple(F.get("__ab", F.lit(i)) for i in range(4)), size, within, most_cells, top, "__a")
    b = _cells(rside.shapes, tuple(F.get("__bb", F.lit(i)) for i in range(4)), size, 0.0, most_cells, top, "__b")
    one_a, one_b = isinstance(left_geom, Point) and not within, isinstance(right_geom, Point)
    if top == 0:
        a, b = _dealt(a, size, "__a", F.lit(0), one_a), _dealt(b, size, "__b", F.lit(0), one_b)
    else:  # two rows meet at the coarser of their levels, so a row is dealt at its own level and all above
        a = _dealt(a.withColumn("__m", F.explode(F.sequence(F.col("__alevel"), F.lit(top)))), size, "__a", F.col("__m"), one_a).drop("__m")
        b = _dealt(b.withColumn("__m", F.explode(F.sequence(F.col("__blevel"), F.lit(top)))), size, "__b", F.col("__m"), one_b).drop("__m")
    n = tasks(left.sparkSession)
    a = a.repartition(n, "__lv", "__cx", "__cy")
    b = b.withColumnsRenamed({"__lv": "__blv", "__cx": "__bcx", "__cy": "__bcy"}).repartition(n, "__blv", "__bcx", "__bcy")
    w = F.lit(size) * F.pow(F.lit(LEVEL_FACTOR), F.col("__lv"))
    meet = (
        (F.col("__lv") == F.col("__blv")) & (F.col("__cx") == F.col("__bcx")) & (F.col("__cy") == F.col("__bcy"))
        & (F.col("__lv") == F.greatest("__alevel", "__blevel"))
        & (F.col("__ax0") <= F.col("__bx1")) & (F.col("__bx0") <= F.col("__ax1")) & (F.col("__ay0") <= F.col("__by1")) & (F.col("__by0") <= F.col("__ay1"))
        & (F.floor(F.greatest("__ax0", "__bx0") / w) == F.col("__cx")) & (F.floor(F.greatest("__ay0", "__by0") / w) == F.col("__cy"))
    )
    pairs = _rows(a.join(b, meet).where(test).select("__aid", "__an", "__bid", "__bn"), lside, rside)
    pairs = pairs if extra is None else pairs.where(extra)
    if not outer:
        return pairs.select(*left.columns, *right.columns)
    if kind in ("left_semi", "left_anti"):
        return lrows.join(pairs.select("__l").distinct(), "__l", kind).select(*left.columns)
    ids = pairs.select("__l", F.col("__r").alias("__rr"))
    if kind == "right":
        rows = rrows.join(ids, F.col("__r") == F.col("__rr"), "left").join(lrows.withColumnRenamed("__l", "__ll"), F.col("__l") == F.col("__ll"), "left")
        return rows.select(*left.columns, *right.columns)
    rows = lrows.withColumnRenamed("__l", "__ll").join(ids, F.col("__ll") == F.col("__l"), "left")
    return rows.join(rrows, F.col("__rr") == F.col("__r"), kind).select(*left.columns, *right.columns)
