"""Opening a raster: validate the request, read its metadata, and make what was asked for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid import args
from sparkgrid.diagnostics import Code, RasterError
from sparkgrid.functions.affine import transform, window_bounds
from sparkgrid.functions.windows import window
from sparkgrid.operators import mesh, metadata, tiling
from sparkgrid.operators.grid import Window, check_window
from sparkgrid.sources import register


def open_raster(
    spark: SparkSession, path: str, arguments: Mapping[str, str] | None = None, metadata_only: bool = False, *,
    lod: str = "off", part: Window | None = None, epsg: int | None = None, tile_size: int | None = None,
) -> dict[str, DataFrame]:
    """Relations of one file: ``metadata``, and for a mesh ``vertices``, ``faces``, ``extent`` and ``conversion``.

    ``lod`` names the sampling step, ``part`` a window of the raster, ``epsg`` a
    CRS that the file leaves out; with ``tile_size`` there are also ``tiles``, one
    row for each square of so many samples.
    """
    asked = args.parse({**args.DEFAULTS, **(arguments or {})}, metadata_only)
    step = args.lod_step(lod)
    if tile_size is not None:
        tiling.check_tile_size(tile_size)
    register(spark)
    rasters = spark.read.format("geogrid").option("relation", "rasters").load(path)
    row = rasters.first()
    if row is None:
        raise RasterError(Code.SourceUnavailable, "there is no raster at the path")
    if not row["has_gt"]:
        raise RasterError(Code.MissingGeoreference, "the file places its pixels nowhere")
    if not any(b["index"] == asked.band for b in row["bands"]):
        raise RasterError(Code.InvalidBandIndex, f"the file has no band {asked.band}", band=asked.band)
    anchor, origin = args.resolve_anchor(row["pixel_anchor"], asked.pixel_anchor)
    gt = transform(*row["gt"])
    whole = window_bounds(gt, F.lit(anchor), window(0, 0, row["width"], row["height"]))
    crs = F.col("crs").withField("epsg", F.lit(args.resolve_epsg(row["crs"]["epsg"], epsg)).cast("int"))
    resolved = rasters.withColumns({"pixel_anchor": F.lit(anchor), "pixel_anchor_source": F.lit(origin), "bounds": whole, "crs": crs})
    out = {"metadata": metadata.metadata_row(resolved, asked.band)}
    if asked.representation == "metadata":
        return out
    part = part or Window(0, 0, row["width"], row["height"])
    check_window(part, row["width"], row["height"], asked.band)
    width, height = part.sampled(step)
    mesh.check_mesh({**row.asDict(), "pixel_anchor": anchor, "bounds": whole}, asked.band, width, height)
    args.check_ceiling(width, height)
    place = {"relation": "pixels", "band": str(asked.band), "step": str(step), "window": f"{part.x},{part.y},{part.width},{part.height}"}
    samples = spark.read.format("geogrid").options(**place).load(path)
    heights = {"fill": asked.fill_value, "scale": asked.height_scale, "offset": asked.height_offset}
    vertices = mesh.vertices(samples, width, gt, F.lit(anchor), whole, asked.nodata, **heights)
    _, a1, a2, _, b1, b2 = row["gt"]
    out["vertices"] = vertices
    out["faces"] = mesh.faces(spark, width, height, samples if asked.nodata == "skip" else None, reverse=a1 * b2 - a2 * b1 < 0)
    out["extent"] = mesh.extent(vertices)
    out["conversion"] = mesh.conversion_record(spark, step, asked.nodata, asked.height_scale, asked.height_offset, asked.fill_value)
    if tile_size is not None:
        tiled = tiling.shared_edges(vertices.select("c", "r").withColumn("level", F.lit(0)), tile_size, width, height)
        out["tiles"] = tiling.manifest(tiled, tile_size)
    return out
