"""Window algebra: rectangles of full-resolution pixels, half open.

A window is a struct (x, y, width, height) of non-negative longs.  Sums and
products that would not fit end at the largest long, as ANSI arithmetic would
raise.  All empty windows are normalised to (0, 0, 0, 0) where they are results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def _long(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("long")


def window(x, y, width, height) -> Column:
    return F.struct(*[_long(v).alias(n) for n, v in zip(("x", "y", "width", "height"), (x, y, width, height), strict=True)])


def added(a, b) -> Column:
    """The sum of two longs, or the largest long."""
    return F.coalesce(F.try_add(_long(a), _long(b)), F.lit(MOST))


def multiplied(a, b) -> Column:
    """The product of two longs, or the largest long."""
    return F.coalesce(F.try_multiply(_long(a), _long(b)), F.lit(MOST))


def div(a, b) -> Column:
    """Integer quotient."""
    return F.call_function("div", _long(a), _long(b))


def end_x(w: Column) -> Column:
    return added(w["x"], w["width"])


def end_y(w: Column) -> Column:
    return added(w["y"], w["height"])


def is_empty(w: Column) -> Column:
    return (w["width"] == 0) | (w["height"] == 0)


def contains_point(w: Column, x, y) -> Column:
    x, y = _long(x), _long(y)
    return ~is_empty(w) & (x >= w["x"]) & (x < end_x(w)) & (y >= w["y"]) & (y < end_y(w))


def contains_window(w: Column, other: Column) -> Column:
    """Whether a window lies in another; an empty one lies in any."""
    inside = (other["x"] >= w["x"]) & (other["y"] >= w["y"]) & (end_x(other) <= end_x(w)) & (end_y(other) <= end_y(w))
    return is_empty(other) | (~is_empty(w) & inside)


def intersect(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    width, height = F.least(end_x(a), end_x(b)) - x, F.least(end_y(a), end_y(b)) - y
    met = ~is_empty(a) & ~is_empty(b) & (width > 0) & (height > 0)
    return F.when(met, window(x, y, width, height)).otherwise(window(0, 0, 0, 0))


def clip(w: Column, width, height) -> Column:
    return intersect(w, window(0, 0, width, height))


def normalised(w: Column) -> Column:
    return F.when(is_empty(w), window(0, 0, 0, 0)).otherwise(w)


def equal(a: Column, b: Column) -> Column:
    return normalised(a) == normalised(b)


def pixel_count(w: Column) -> Column:
    return multiplied(w["width"], w["height"])


def sampled_extent(extent, step) -> Column:
    """Samples along an extent: rounded up, a step of 0 being 1."""
    extent, step = _long(extent), F.greatest(_long(step), F.lit(1))
    return div(extent, step) + F.when(extent % step != 0, 1).otherwise(0)


def to_overview(w: Column, factor) -> Column:
    """The window in pixels of an overview: origin rounded down, end up."""
    factor = F.greatest(_long(factor), F.lit(1))
    x, y = div(w["x"], factor), div(w["y"], factor)
    made = window(x, y, sampled_extent(end_x(w), factor) - x, sampled_extent(end_y(w), factor) - y)
    return F.when(is_empty(w) & (factor > 1), window(0, 0, 0, 0)).when(factor <= 1, w).otherwise(made)


def from_overview(w: Column, factor) -> Column:
    """The window in full-resolution pixels; an empty one stays as it is."""
    made = window(*[multiplied(w[c], F.greatest(_long(factor), F.lit(1))) for c in ("x", "y", "width", "height")])
    return F.when(is_empty(w), w).otherwise(made)


def subdivide(w: Column, tile_width, tile_height) -> Column:
    """An array of windows that cover one exactly, row by row, to be exploded; empty for an empty window."""
    tile_width, tile_height = _long(tile_width), _long(tile_height)
    across, down = sampled_extent(w["width"], tile_width), sampled_extent(w["height"], tile_height)

    def tile(k: Column) -> Column:
        c, r = k % across, div(k, across)
        return window(
            w["x"] + c * tile_width, w["y"] + r * tile_height,
            F.least(tile_width, w["width"] - c * tile_width), F.least(tile_height, w["height"] - r * tile_height),
        )

    tiles = F.transform(F.sequence(F.lit(0).cast("long"), across * down - 1), tile)
    return F.when(~is_empty(w), tiles).otherwise(F.slice(F.array(window(0, 0, 0, 0)), 1, 0))


def overview_factor(width, overview_width) -> Column:
    """Full-resolution pixels for one of an overview, rounded; 0 if there is none."""
    width, overview_width = _long(width), _long(overview_width)
    return F.when(overview_width > 0, div(width + div(overview_width, F.lit(2)), overview_width)).otherwise(F.lit(0).cast("long"))
