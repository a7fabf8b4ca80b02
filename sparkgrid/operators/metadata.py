"""Metadata as a row: what a raster states, absent things being null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.functions.affine import TERMS
from sparkgrid.functions.bounds import AXES, local_origin


def find_band(bands: Column, index: int) -> Column:
    """The band of that 1-based index; null if there is none."""
    return F.get(F.filter(bands, lambda b: b["index"] == index), F.lit(0))


def if_every(bands: Column, field: str) -> Column:
    """A band array that is stated only if every band has the field."""
    whole = (F.size(bands) > 0) & F.forall(bands, lambda b: b[field].isNotNull())
    return F.when(whole, F.transform(bands, lambda b: b[field]))


def if_any(bands: Column, field: str) -> Column:
    """A band array of texts that is stated if any band has one; the others are empty."""
    stated = F.exists(bands, lambda b: F.coalesce(b[field], F.lit("")) != "")
    return F.when(stated, F.transform(bands, lambda b: F.coalesce(b[field], F.lit(""))))


def band_arrays(bands: Column) -> dict[str, Column]:
    return {
        "raster:bandIndices": F.transform(bands, lambda b: b["index"]),
        "raster:bandDataTypes": F.transform(bands, lambda b: b["data_type"]),
        "raster:bandDescriptions": if_any(bands, "description"),
        "raster:bandUnits": if_any(bands, "unit"),
        "raster:bandScales": if_every(bands, "scale"),
        "raster:bandOffsets": if_every(bands, "offset"),
        "raster:bandNoDataValues": if_every(bands, "nodata"),
    }


def known(unit: Column) -> Column:
    return F.when(unit != "unknown", unit)


def metadata_row(rasters: DataFrame, band: int = 1, anchor_source: str | None = None) -> DataFrame:
    """One row of properties for each row of ``rasters``."""
    crs, gt, bands, b = F.col("crs"), F.col("gt"), F.col("bands"), F.col("bounds")
    chosen = find_band(bands, band)
    wkt = F.when(crs["wkt"] != "", crs["wkt"])
    properties = {
        "geo:sourceIdentifier": F.col("source_label"),
        "geo:crs": F.coalesce(F.concat(F.lit("EPSG:"), crs["epsg"].cast("string")), wkt),
        "geo:crsWkt": wkt,
        "geo:linearUnit": known(crs["linear_unit"]),
        "geo:verticalUnit": known(crs["vertical_unit"]),
        "geo:localOrigin": F.array(*[local_origin(b, a) for a in AXES]),
        "geo:boundsMin": F.array(*[b[f"min_{a}"] for a in AXES]),
        "geo:boundsMax": F.array(*[b[f"max_{a}"] for a in AXES]),
        "raster:width": F.col("width"),
        "raster:height": F.col("height"),
        "raster:bandCount": F.col("band_count"),
        "raster:geoTransform": F.array(*[gt[t] for t in TERMS]),
        "raster:pixelAnchor": F.coalesce(F.col("pixel_anchor"), F.lit("unknown")),
        "raster:pixelAnchorSource": F.coalesce(F.lit(anchor_source), F.col("pixel_anchor_source")),
        "raster:dataType": chosen["data_type"],
        "raster:selectedBand": F.lit(band),
        "raster:overviewCount": F.size("overviews"),
        **band_arrays(bands),
        "raster:noDataValue": chosen["nodata"],
        "raster:nativeTileWidth": F.col("native_tile")["width"],
        "raster:nativeTileHeight": F.col("native_tile")["height"],
    }
    return rasters.select("raster_id", *[c.alias(n) for n, c in properties.items()])


def is_tiled(rasters: DataFrame) -> Column:
    return F.col("native_tile").isNotNull()


def export(rows: DataFrame, path: str) -> None:
    """Metadata rows as JSON lines; absent properties are left out, as null fields are."""
    rows.write.json(path)
