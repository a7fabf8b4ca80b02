"""Pixel to source coordinates and back.

A transform is a struct (a0, a1, a2, b0, b1, b2) with X = a0 + a1 px + a2 py and
Y = b0 + b1 px + b2 py, evaluated in that order so that results are reproducible
to the bit.  An anchor is 'area', 'point' or null (unknown).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = ("a0", "a1", "a2", "b0", "b1", "b2")


def transform(*terms) -> Column:
    """The struct of six terms, columns or numbers."""
    return F.struct(*[(t if isinstance(t, Column) else F.lit(float(t))).cast("double").alias(n) for n, t in zip(TERMS, terms, strict=True)])


def from_scale_and_tiepoint(sx, sy, px, py, x, y) -> Column:
    """North-up transform of a pixel size and one pixel's known place."""
    sx, sy, px, py, x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (sx, sy, px, py, x, y))
    return transform(x - sx * px, sx, 0.0, y - (-sy) * py, 0.0, -sy)


def from_matrix(m: Column) -> Column:
    """From the 16 numbers of a 4 x 4 matrix, row by row."""
    return transform(m[3], m[0], m[1], m[7], m[4], m[5])


def apply_transform(gt: Column, px: Column, py: Column) -> tuple[Column, Column]:
    return gt["a0"] + gt["a1"] * px + gt["a2"] * py, gt["b0"] + gt["b1"] * px + gt["b2"] * py


def pixel_coord(anchor: Column, i: Column) -> Column:
    """Continuous place of an index: the cell's centre for areas, else the index."""
    return F.when(anchor == "area", i + F.lit(0.5)).otherwise(i.cast("double"))


def pixel_to_source(gt: Column, anchor: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """Null for an unknown anchor."""
    x, y = apply_transform(gt, pixel_coord(anchor, i), pixel_coord(anchor, j))
    return F.when(anchor.isNotNull(), x), F.when(anchor.isNotNull(), y)


def determinant(gt: Column) -> Column:
    return gt["a1"] * gt["b2"] - gt["a2"] * gt["b1"]


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def is_invertible(gt: Column) -> Column:
    """A finite determinant that is not lost in the coefficients' rounding."""
    det = determinant(gt)
    scale = F.abs(gt["a1"]) + F.abs(gt["a2"]) + F.abs(gt["b1"]) + F.abs(gt["b2"])
    return is_finite(det) & (det != 0.0) & (F.abs(det) > scale * scale * F.lit(1e-15))


def inverse(gt: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Continuous pixel place of a source coordinate; null if there is no inverse."""
    dx, dy, det = x - gt["a0"], y - gt["b0"], determinant(gt)
    good = is_invertible(gt)
    px = F.try_divide(gt["b2"] * dx - gt["a2"] * dy, det)
    py = F.try_divide(gt["a1"] * dy - gt["b1"] * dx, det)
    return F.when(good, px), F.when(good, py)


def source_to_pixel(gt: Column, anchor: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Index of the pixel at a source coordinate; null outside the raster or without anchor or inverse."""
    half = F.when(anchor == "area", F.lit(0.5)).otherwise(F.lit(0.0))
    fx, fy = (F.floor(p - half + F.lit(0.5)) for p in inverse(gt, x, y))
    inside = anchor.isNotNull() & (fx >= 0) & (fx < width) & (fy >= 0) & (fy < height)
    return F.when(inside, fx), F.when(inside, fy)


def is_rotated(gt: Column) -> Column:
    return (gt["a2"] != 0.0) | (gt["b1"] != 0.0)


def is_north_up(gt: Column) -> Column:
    return ~is_rotated(gt) & (gt["a1"] > 0.0) & (gt["b2"] < 0.0)


def is_south_up(gt: Column) -> Column:
    return ~is_rotated(gt) & (gt["b2"] > 0.0)


def pixel_width(gt: Column) -> Column:
    return F.sqrt(gt["a1"] * gt["a1"] + gt["b1"] * gt["b1"])


def pixel_height(gt: Column) -> Column:
    return F.sqrt(gt["a2"] * gt["a2"] + gt["b2"] * gt["b2"])


def window_bounds(gt: Column, anchor: Column, window: Column) -> Column:
    """Bounds struct of a window's corners: whole cells for areas, centres for points; null for an empty window or no anchor."""
    less = F.when(anchor == "area", F.lit(0)).otherwise(F.lit(1))
    xs = [window["x"].cast("double"), (window["x"] + window["width"] - less).cast("double")]
    ys = [window["y"].cast("double"), (window["y"] + window["height"] - less).cast("double")]
    corners = [apply_transform(gt, px, py) for py in ys for px in xs]
    east, north = [c[0] for c in corners], [c[1] for c in corners]
    made = F.struct(
        F.least(*east).alias("min_x"), F.least(*north).alias("min_y"), F.lit(0.0).alias("min_z"),
        F.greatest(*east).alias("max_x"), F.greatest(*north).alias("max_y"), F.lit(0.0).alias("max_z"),
    )
    return F.when(anchor.isNotNull() & (window["width"] > 0) & (window["height"] > 0), made)


def scaled_degrees(gt: Column, metres_per_degree: float) -> Column:
    """A geographic transform in metres by one factor: an explicit, lossy approximation that callers record as such."""
    return transform(*[gt[t] * F.lit(float(metres_per_degree)) for t in TERMS])
