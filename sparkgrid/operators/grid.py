"""Pixels: one row for each sample of a band.

``pixels(i, j, value)`` holds source pixels; a read adds the column and row of the
sample, ``c`` and ``r``.  Windows, bands and strides are plain filters on i and j,
which Catalyst pushes into a Parquet scan or into the raster source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.diagnostics import Code, RasterError
from sparkgrid.functions.types import SAMPLE_TYPES, exactly_representable
from sparkgrid.functions.values import converted, matches_nodata, scaled
from sparkgrid.functions.windows import div


@dataclass(frozen=True)
class Window:
    """A rectangle of full-resolution pixels, half open."""

    x: int
    y: int
    width: int
    height: int

    @property
    def empty(self) -> bool:
        return not (self.width and self.height)

    def inside(self, width: int, height: int) -> bool:
        return 0 <= self.x and 0 <= self.y and self.x + self.width <= width and self.y + self.height <= height

    def sampled(self, step: int) -> tuple[int, int]:
        """Samples across and down at a step."""
        step = max(1, step)
        return -(-self.width // step), -(-self.height // step)


def from_table(rows: DataFrame, i: Column, j: Column, value: Column, *others: Column) -> DataFrame:
    """Pixels from any table with their places; nothing is read that is not named."""
    return rows.select(i.cast("long").alias("i"), j.cast("long").alias("j"), value.cast("double").alias("value"), *others)


def from_arrays(rows: DataFrame, j: Column, samples: Column) -> DataFrame:
    """Pixels from one row of samples for each line."""
    spread = rows.select(j.cast("long").alias("j"), F.posexplode(samples).alias("i", "value"))
    return spread.select(F.col("i").cast("long").alias("i"), "j", F.col("value").cast("double").alias("value"))


def check_window(window: Window, width: int, height: int, band: int | None = None) -> None:
    """A read never clips silently."""
    if not window.inside(width, height):
        raise RasterError(Code.WindowOutOfBounds, "the requested window is outside the raster", window=(window.x, window.y, window.width, window.height), band=band)


def in_window(window: Window) -> Column:
    i, j = F.col("i"), F.col("j")
    return (i >= window.x) & (i < window.x + window.width) & (j >= window.y) & (j < window.y + window.height)


def read_window(pixels: DataFrame, window: Window, step: int = 1, size: tuple[int, int] | None = None) -> DataFrame:
    """Samples of a window at a step anchored at its origin; ``c`` and ``r`` count them."""
    if size:
        check_window(window, *size)
    step = max(1, step)
    kept = pixels.filter(in_window(window))
    di, dj = F.col("i") - window.x, F.col("j") - window.y
    if step > 1:
        kept = kept.filter((di % step == 0) & (dj % step == 0))
    return kept.withColumns({"c": div(di, F.lit(step)), "r": div(dj, F.lit(step))})


def choose_overview(width: int, overview_widths: list[int], step: int, level: int | None = None) -> int | None:
    """The level to read: that asked for, or the last in file order whose factor fits the step."""
    if level is not None:
        if level >= len(overview_widths):
            raise RasterError(Code.UnsupportedOverviewLevel, "the requested overview level does not exist")
        return level
    fitting = [k for k, w in enumerate(overview_widths) if w and 0 < factor_of(width, w) <= max(1, step)]
    return fitting[-1] if fitting else None


def factor_of(width: int, overview_width: int) -> int:
    """Full-resolution pixels for one of the overview, rounded."""
    return (width + overview_width // 2) // overview_width if overview_width else 0


def build_overview(pixels: DataFrame, factor: int) -> DataFrame:
    """A level by decimation: every factor-th sample, never a mean of several."""
    kept = pixels.filter((F.col("i") % factor == 0) & (F.col("j") % factor == 0))
    return kept.withColumns({"i": div(F.col("i"), F.lit(factor)), "j": div(F.col("j"), F.lit(factor))})


def read_overview(level: DataFrame, window: Window, factor: int, step: int) -> DataFrame:
    """Samples of a full-resolution window from a level: that at or before each source pixel.

    The level's pixels are spread to the samples that they serve, at most one
    for each where the step is no less than the factor, so no join is needed.
    """
    step = max(step, factor)
    across, down = window.sampled(step)

    def serves(at: str, first: int, count: int) -> Column:
        """Samples k with (first + k * step) div factor = at."""
        low = F.greatest(F.lit(0), -div(F.lit(first) - F.col(at) * factor, F.lit(step)))
        k = F.transform(F.sequence(low - 1, low + 1), lambda n: n)
        return F.filter(k, lambda n: (n >= 0) & (n < count) & (div(F.lit(first) + n * step, F.lit(factor)) == F.col(at)))

    spread = level.withColumns({"c": F.explode(serves("i", window.x, across))})
    spread = spread.withColumns({"r": F.explode(serves("j", window.y, down))})
    source = {"i": F.lit(window.x) + F.col("c") * step, "j": F.lit(window.y) + F.col("r") * step}
    return spread.withColumns(source)


def decode(pixels: DataFrame, scale: Column | None = None, offset: Column | None = None, output_type: str = "float64", nodata: float | None = None, nodata_stage: str = "converted") -> DataFrame:
    """Scale and offset, then the output type, then whether the sample is missing.

    A declared NoData value is compared with the converted sample, or with the
    raw one where ``nodata_stage`` is "raw".
    """
    none = F.lit(None).cast("double")
    raw = F.col("value")
    value = converted(scaled(raw, none if scale is None else scale, none if offset is None else offset), output_type)
    missing = F.lit(nodata).cast("double")
    return pixels.withColumns({"value": value, "is_nodata": matches_nodata(raw if nodata_stage == "raw" else value, missing)})


def is_lossy(source_type: str, output_type: str) -> bool:
    """Whether a read in that type warns of a lossy conversion."""
    return source_type != output_type and not exactly_representable(source_type, output_type)


def requested_bytes(window: Window, sample_type: str) -> int:
    return window.width * window.height * SAMPLE_TYPES[sample_type].size


def tile_at(pixels: DataFrame, seg_x: int, seg_y: int, tile_width: int, tile_height: int, width: int, height: int) -> DataFrame:
    """The samples of a native tile, clipped to the raster."""
    x, y = seg_x * tile_width, seg_y * tile_height
    if x >= width or y >= height:
        raise RasterError(Code.WindowOutOfBounds, "the requested tile is outside the raster")
    return read_window(pixels, Window(x, y, min(tile_width, width - x), min(tile_height, height - y)))


def scanlines(pixels: DataFrame, first: int, count: int, width: int, height: int) -> DataFrame:
    """Whole lines of the raster."""
    return read_window(pixels, Window(0, first, width, count), size=(width, height))


def sample_or_zero(pixels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values at (c, r) of ``wanted``; 0.0 where there is no sample."""
    return wanted.join(pixels.select("c", "r", "value"), ["c", "r"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def locate(points: DataFrame, pixels: DataFrame, gt: Column, anchor: Column, width: int, height: int) -> DataFrame:
    """Points (x, y) with the pixel each lies in: an equi-join on computed places."""
    from sparkgrid.functions.affine import source_to_pixel

    i, j = source_to_pixel(gt, anchor, F.col("x"), F.col("y"), F.lit(width), F.lit(height))
    return points.withColumns({"i": i, "j": j}).join(pixels, ["i", "j"])
