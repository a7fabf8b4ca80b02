"""NoData, scale and offset, and conversion between sample types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrid.functions.affine import is_finite
from sparkgrid.functions.types import SAMPLE_TYPES


def matches_nodata(value: Column, nodata: Column) -> Column:
    """Equal to the declared value; Spark holds NaN equal to NaN and -0.0 to 0.0; false without one."""
    return nodata.isNotNull() & F.coalesce(value == nodata, F.lit(False))


def same_nodata(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def scaled(raw: Column, scale: Column, offset: Column) -> Column:
    """raw * scale + offset, each only where it is set, so that -0.0 and NaN pass unharmed."""
    times = F.when(scale.isNull(), raw).otherwise(raw * scale)
    return F.when(offset.isNull(), times).otherwise(times + offset)


def converted(value: Column, sample_type: str) -> Column:
    """The value as a sample type holds it, as a double.

    Integers: 0 for what is not finite, then clamped, then cut toward zero.
    """
    kind = SAMPLE_TYPES[sample_type]
    if kind.name == "float64":
        return value
    if kind.floating:
        return value.cast("float").cast("double")
    low, high = kind.range  # type: ignore[misc]
    clamped = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(is_finite(value), clamped.cast("long").cast("double")).otherwise(F.lit(0.0))


def elevation(value: Column, is_nodata: Column, policy: str, fill: float | None = None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A vertex's height: missing cells are 0 (skip), the fill value, or the value itself (keep), then scaled."""
    if policy == "fill":
        base = F.when(is_nodata, F.lit(float(fill))).otherwise(value)  # type: ignore[arg-type]
    elif policy == "skip":
        base = F.when(is_nodata, F.lit(0.0)).otherwise(value)
    elif policy == "keep":
        base = value
    else:
        raise ValueError(f"no such policy: {policy}")
    return F.lit(float(scale)) * base + F.lit(float(offset))
