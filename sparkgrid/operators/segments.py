"""Segments of a raster file, tiles or strips, as a relation, and which a window needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.functions.windows import div, end_x, end_y, intersect, is_empty


def layout(spark: SparkSession, width: int, height: int, tile_width: int, tile_height: int, planes: int = 1) -> DataFrame:
    """Every segment's place: (plane, segment, x0, y0, w, h); strips are tiles of the raster's width."""
    across, down = -(-width // tile_width), -(-height // tile_height)
    per_plane = across * down
    k = F.col("id") % per_plane
    x0, y0 = (k % across) * tile_width, div(k, F.lit(across)) * tile_height
    return spark.range(per_plane * planes).select(
        (div(F.col("id"), F.lit(per_plane)) + 1).cast("int").alias("plane"), k.alias("segment"), x0.alias("x0"), y0.alias("y0"),
        F.least(F.lit(tile_width), F.lit(width) - x0).cast("long").alias("w"), F.least(F.lit(tile_height), F.lit(height) - y0).cast("long").alias("h"),
    )


def overlapping(segments: DataFrame, windows: DataFrame, tile_width: int, tile_height: int) -> DataFrame:
    """Pairs of windows (window_id, w struct) and the segments (segment, x0, y0, w, h) that they meet.

    On a regular layout the segments that a window meets are computed, so the
    overlap is an equi-join on the segment's place and not a comparison of all.
    """
    w = F.col("win")
    span = lambda a, b, size: F.sequence(div(a, F.lit(size)), div(b - 1, F.lit(size)))
    wanted = windows.filter(~is_empty(w)).withColumn("x0", F.explode(span(w["x"], end_x(w), tile_width)))
    wanted = wanted.withColumn("y0", F.explode(span(w["y"], end_y(w), tile_height)))
    wanted = wanted.withColumns({"x0": F.col("x0") * tile_width, "y0": F.col("y0") * tile_height})
    met = wanted.join(segments, ["x0", "y0"])
    return met.withColumn("overlap", intersect(w, segment_window()))


def segment_window() -> Column:
    return F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("w").alias("width"), F.col("h").alias("height"))
