"""Axis-aligned bounds and the local origin.

Bounds are a struct (min_x, min_y, min_z, max_x, max_y, max_z), null if empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrid.functions.affine import is_finite

AXES = ("x", "y", "z")
FIELDS = [f"{side}_{axis}" for side in ("min", "max") for axis in AXES]


def bounds(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(FIELDS, values, strict=True)])


def is_valid(b: Column) -> Column:
    """Present, finite and not inverted."""
    good = b.isNotNull()
    for axis in AXES:
        low, high = b[f"min_{axis}"], b[f"max_{axis}"]
        good = good & is_finite(low) & is_finite(high) & (low <= high)
    return F.coalesce(good, F.lit(False))


def expand(x: Column, y: Column, z: Column) -> Column:
    """Aggregate: bounds of points; one with a component that is not finite is ignored whole."""
    good = is_finite(x) & is_finite(y) & is_finite(z)
    sides = [f(F.when(good, v)) for f in (F.min, F.max) for v in (x, y, z)]
    return F.when(sides[0].isNotNull(), bounds(*sides))


def union(b: Column) -> Column:
    """Aggregate: bounds of bounds; invalid ones add nothing."""
    sides = [(F.min if n.startswith("min") else F.max)(F.when(is_valid(b), b[n])) for n in FIELDS]
    return F.when(sides[0].isNotNull(), bounds(*sides))


def size(b: Column, axis: str) -> Column:
    return F.when(is_valid(b), b[f"max_{axis}"] - b[f"min_{axis}"]).otherwise(F.lit(0.0))


def center(b: Column, axis: str) -> Column:
    return F.when(is_valid(b), b[f"min_{axis}"] + (b[f"max_{axis}"] - b[f"min_{axis}"]) * F.lit(0.5)).otherwise(F.lit(0.0))


def same_bounds(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def half_away(v: Column) -> Column:
    """The nearest whole number, halves away from zero, without a detour over decimals."""
    low = F.floor(F.abs(v)).cast("double")
    near = low + F.when(F.abs(v) - low >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    # From 2^52 on every double is whole.
    return F.when(F.abs(v) >= float(1 << 52), v).otherwise(F.signum(v) * near)


def local_origin(b: Column, axis: str, quantum: float = 1.0) -> Column:
    """The bounds' centre on an axis, on a grid of ``quantum`` if that is positive; 0 for invalid bounds."""
    middle = center(b, axis)
    if quantum <= 0:
        return middle
    return half_away(middle / F.lit(float(quantum))) * F.lit(float(quantum))


def to_local(v: Column, origin: Column) -> Column:
    return v - origin


def to_source(v: Column, origin: Column) -> Column:
    return v + origin


def vector(x, y, z) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(AXES, (x, y, z), strict=True)])


def vector_sum(a: Column, b: Column) -> Column:
    return vector(*[a[n] + b[n] for n in AXES])


def vector_difference(a: Column, b: Column) -> Column:
    return vector(*[a[n] - b[n] for n in AXES])
