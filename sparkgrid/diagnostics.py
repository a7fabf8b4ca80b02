"""Typed diagnostics: codes, an exception, and the rows of the diagnostics relation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Code(str, Enum):
    """The stable names of diagnostics."""

    InvalidSignature = "InvalidSignature"
    UnsupportedVersion = "UnsupportedVersion"
    TruncatedHeader = "TruncatedHeader"
    TruncatedData = "TruncatedData"
    InvalidOffset = "InvalidOffset"
    ShortRead = "ShortRead"
    SourceUnavailable = "SourceUnavailable"
    UnsupportedCompression = "UnsupportedCompression"
    UnsupportedSampleFormat = "UnsupportedSampleFormat"
    UnsupportedPlanarConfiguration = "UnsupportedPlanarConfiguration"
    InvalidRasterSize = "InvalidRasterSize"
    InvalidBandIndex = "InvalidBandIndex"
    InconsistentTileLayout = "InconsistentTileLayout"
    MissingGeoreference = "MissingGeoreference"
    InvalidGeoTransform = "InvalidGeoTransform"
    ConflictingGeoTransform = "ConflictingGeoTransform"
    UnknownPixelAnchor = "UnknownPixelAnchor"
    InvalidCrs = "InvalidCrs"
    ConflictingCrs = "ConflictingCrs"
    UnsupportedCrs = "UnsupportedCrs"
    NonFiniteValue = "NonFiniteValue"
    InvalidNoDataValue = "InvalidNoDataValue"
    LossyConversion = "LossyConversion"
    WindowOutOfBounds = "WindowOutOfBounds"
    UnsupportedOverviewLevel = "UnsupportedOverviewLevel"
    MemoryBudgetExceeded = "MemoryBudgetExceeded"
    Cancelled = "Cancelled"
    UnknownFormatArgument = "UnknownFormatArgument"
    UnsupportedFormatArgument = "UnsupportedFormatArgument"
    InvalidFormatArgument = "InvalidFormatArgument"
    ConflictingFormatArguments = "ConflictingFormatArguments"
    AuthoringFailed = "AuthoringFailed"
    VertexBudgetExceeded = "VertexBudgetExceeded"


#: Published code of each name; names without one are GTIF003.
#: GTIF011, GTIF015 and GTIF017 are as documented.
PLUGIN_CODES = {
    Code.InvalidSignature: "GTIF001",
    Code.TruncatedHeader: "GTIF001",
    Code.UnsupportedVersion: "GTIF002",
    Code.InvalidOffset: "GTIF003",
    Code.TruncatedData: "GTIF003",
    Code.UnsupportedCompression: "GTIF004",
    Code.UnsupportedSampleFormat: "GTIF005",
    Code.UnsupportedPlanarConfiguration: "GTIF005",
    Code.MissingGeoreference: "GTIF006",
    Code.ConflictingGeoTransform: "GTIF007",
    Code.InvalidGeoTransform: "GTIF008",
    Code.UnknownPixelAnchor: "GTIF009",
    Code.InvalidBandIndex: "GTIF010",
    Code.WindowOutOfBounds: "GTIF011",
    Code.VertexBudgetExceeded: "GTIF012",
    Code.UnknownFormatArgument: "GTIF013",
    Code.UnsupportedFormatArgument: "GTIF013",
    Code.InvalidFormatArgument: "GTIF013",
    Code.ConflictingFormatArguments: "GTIF013",
    Code.ShortRead: "GTIF014",
    Code.SourceUnavailable: "GTIF014",
    Code.LossyConversion: "GTIF015",
    Code.MemoryBudgetExceeded: "GTIF016",
    Code.Cancelled: "GTIF017",
    Code.InvalidNoDataValue: "GTIF018",
    Code.AuthoringFailed: "GTIF019",
}
OTHER_CODE = "GTIF003"

ROW = (
    "raster_id string, seq int, code string, severity string, message string, byte_offset long, pixel_x long, pixel_y long, "
    "window struct<x:long,y:long,width:long,height:long>, band int, plugin_code string"
)


@dataclass
class Diagnostic:
    """What went wrong, with as much of its place as is known."""

    code: Code
    message: str
    severity: str = "Error"
    byte_offset: int | None = None
    pixel: tuple[int, int] | None = None
    window: tuple[int, int, int, int] | None = None
    band: int | None = None

    @property
    def plugin_code(self) -> str:
        return PLUGIN_CODES.get(self.code, OTHER_CODE)

    def row(self, raster_id: str, seq: int) -> tuple:
        x, y = self.pixel or (None, None)
        return (raster_id, seq, self.code.value, self.severity, self.message, self.byte_offset, x, y, self.window, self.band, self.plugin_code)


class RasterError(Exception):
    """A diagnostic that ends the read."""

    def __init__(self, code: Code, message: str, **place):
        self.diagnostic = Diagnostic(code, message, **place)
        super().__init__(f"[{self.diagnostic.plugin_code}] {code.value}: {message}")

    def __reduce__(self):
        d = self.diagnostic
        return _again, (d.code, d.message, {"byte_offset": d.byte_offset, "pixel": d.pixel, "window": d.window, "band": d.band})


def _again(code: Code, message: str, place: dict) -> RasterError:
    return RasterError(code, message, **place)


@dataclass
class Sink:
    """Diagnostics in the order they came."""

    found: list[Diagnostic] = field(default_factory=list)

    def warn(self, code: Code, message: str, **place) -> None:
        self.found.append(Diagnostic(code, message, "Warning", **place))

    def fail(self, code: Code, message: str, **place) -> None:
        self.found.append(Diagnostic(code, message, "Error", **place))

    @property
    def has_error(self) -> bool:
        return any(d.severity == "Error" for d in self.found)

    def report(self, source: str) -> bool:
        """Warn of warnings; raise the first error; True if there was none."""
        for d in self.found:
            if d.severity == "Warning":
                warnings.warn(f"[{d.plugin_code}] {source}: {d.message}", stacklevel=2)
        for d in self.found:
            if d.severity == "Error":
                raise RasterError(d.code, f"{source}: {d.message}", byte_offset=d.byte_offset, pixel=d.pixel, window=d.window, band=d.band)
        return True

    def frame(self, spark: SparkSession, raster_id: str) -> DataFrame:
        return spark.createDataFrame([d.row(raster_id, i) for i, d in enumerate(self.found)], ROW)


def counts(diagnostics: DataFrame) -> DataFrame:
    """Errors and warnings of each raster."""
    return diagnostics.groupBy("raster_id").agg(
        F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings")
    )
