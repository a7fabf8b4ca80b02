"""Sample types, units and their stable names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SampleType:
    """Size in bytes, kind, and range of the integers (None for floats)."""

    name: str
    size: int
    floating: bool
    signed: bool

    @property
    def range(self) -> tuple[int, int] | None:
        if self.floating:
            return None
        bits = self.size * 8
        return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if self.signed else (0, (1 << bits) - 1)

    @property
    def exact_bits(self) -> int:
        """Bits of an integer that the type holds whatever they are."""
        return {4: 24, 8: 53}[self.size] if self.floating else self.size * 8 - self.signed


#: The sample types by name.
SAMPLE_TYPES = {
    t.name: t
    for t in (
        SampleType("uint8", 1, False, False),
        SampleType("int8", 1, False, True),
        SampleType("uint16", 2, False, False),
        SampleType("int16", 2, False, True),
        SampleType("uint32", 4, False, False),
        SampleType("int32", 4, False, True),
        SampleType("float32", 4, True, True),
        SampleType("float64", 8, True, True),
    )
}
#: Metres in a linear unit.
METRES_PER_UNIT = {"metre": 1.0, "foot": 0.3048, "USSurveyFoot": 1200.0 / 3937.0, "unknown": 0.0}
#: Other stable spellings.
ANGULAR_UNITS = ("degree", "radian", "unknown")
CRS_KINDS = ("projected", "geographic", "unknown")
PIXEL_ANCHORS = ("area", "point")
NODATA_POLICIES = ("skip", "fill", "keep")


def exactly_representable(source: str, target: str) -> bool:
    """Whether every value of one sample type is a value of another."""
    s, t = SAMPLE_TYPES[source], SAMPLE_TYPES[target]
    if s == t:
        return True
    if s.floating:
        return t.floating and t.size > s.size
    return (t.signed or not s.signed) and t.exact_bits >= s.exact_bits


def representability(spark: SparkSession) -> DataFrame:
    """The 64 pairs of sample types, with whether the conversion is exact."""
    rows = [(a, b, exactly_representable(a, b)) for a in SAMPLE_TYPES for b in SAMPLE_TYPES]
    return spark.createDataFrame(rows, "source_type string, target_type string, exact boolean")


def metres_per_unit(unit: Column) -> Column:
    known = F.lit(None).cast("double")
    for name, metres in METRES_PER_UNIT.items():
        known = F.when(unit == name, F.lit(metres)).otherwise(known)
    return F.coalesce(known, F.lit(0.0))


def crs_is_empty(crs: Column) -> Column:
    """Nothing is known of the CRS."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    unknown = lambda c: F.coalesce(c, F.lit("unknown")) == "unknown"
    return (
        unknown(crs["kind"])
        & crs["epsg"].isNull()
        & blank(crs["wkt"])
        & blank(crs["citation"])
        & unknown(crs["linear_unit"])
        & (F.coalesce(crs["linear_unit_metres"], F.lit(0.0)) == 0.0)
        & unknown(crs["angular_unit"])
        & crs["vertical_epsg"].isNull()
        & unknown(crs["vertical_unit"])
        & blank(crs["vertical_citation"])
    )


def crs_is_metric(crs: Column) -> Column:
    """Projected, with a known unit or a positive length of it."""
    known = F.coalesce(crs["linear_unit"], F.lit("unknown")) != "unknown"
    return (F.coalesce(crs["kind"], F.lit("unknown")) == "projected") & (known | (F.coalesce(crs["linear_unit_metres"], F.lit(0.0)) > 0.0))


def crs_has_mixed_units(crs: Column) -> Column:
    """Both units are known and differ."""
    level, height = (F.coalesce(crs[c], F.lit("unknown")) for c in ("linear_unit", "vertical_unit"))
    return (level != "unknown") & (height != "unknown") & (level != height)


def crs_equal(a: Column, b: Column) -> Column:
    """Equal in every field, absent ones being equal to absent ones."""
    return a.eqNullSafe(b)
