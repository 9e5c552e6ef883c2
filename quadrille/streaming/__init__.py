"""Structured Streaming over feature streams: windowed counts with late data, and joins with static features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.geometry.native import Box, Point, inside


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or hopping window and key; on a stream state is kept for ``lateness`` after a window."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    return marked.groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Counts per session: rows of a key without a pause of ``gap``."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def inside_boxes(points: DataFrame, boxes: DataFrame, point: Point, box: Box, cell: float) -> DataFrame:
    """Stream-static join of points with static boxes through grid cells of width ``cell``; stateless."""
    x0, y0, x1, y1 = box.bounds()
    dealt = boxes.withColumn("__cx", F.explode(F.sequence(F.floor(x0 / cell), F.floor(x1 / cell)))).withColumn("__cy", F.explode(F.sequence(F.floor(y0 / cell), F.floor(y1 / cell))))
    x, y, _, _ = point.bounds()
    hashed = points.withColumns({"__px": F.floor(x / cell), "__py": F.floor(y / cell)})
    found = hashed.join(dealt, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & inside(box, point))
    return found.drop("__px", "__py", "__cx", "__cy")
