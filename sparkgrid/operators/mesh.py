"""Regular-grid meshes: vertices, faces and extent of a read window.

Vertices are an expression on pixels; their local origin needs the range of the
heights, which is a scalar subquery.  Faces come from arithmetic on a range of
ids, less those that touch a missing cell, an anti-join on the face's key; no
row ever carries its neighbours.  Vertex and face ids are positions in row-major
order, so rows need no order before they reach a sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.diagnostics import Code, RasterError
from sparkgrid.functions.affine import pixel_to_source
from sparkgrid.functions.bounds import AXES, bounds, local_origin, to_local
from sparkgrid.functions.values import elevation
from sparkgrid.functions.windows import div

#: What every mesh states.
ORIENTATION, SUBDIVISION = "rightHanded", "none"
LARGEST_INDEX = (1 << 31) - 1


def placed(samples: DataFrame, width: int, gt: Column, anchor: Column, policy: str = "skip", fill: float | None = None, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Samples (c, r, i, j, value, is_nodata) with vertex_id and source place."""
    x, y = pixel_to_source(gt, anchor, F.col("i"), F.col("j"))
    return samples.select(
        (F.col("r") * width + F.col("c")).alias("vertex_id"), "c", "r", "i", "j",
        x.alias("source_x"), y.alias("source_y"),
        elevation(F.col("value"), F.col("is_nodata"), policy, fill, scale, offset).alias("source_z"), "is_nodata",
    )


def elevation_range(vertices: DataFrame, policy: str = "skip") -> DataFrame:
    """One row, min_z and max_z, of the vertices that count; NaN never does."""
    counts = ~F.isnan("source_z")
    if policy == "skip":
        counts &= ~F.col("is_nodata")
    z = F.when(counts, F.col("source_z"))
    return vertices.agg(F.min(z).alias("min_z"), F.max(z).alias("max_z"))


def mesh_bounds(flat: Column, heights: DataFrame) -> DataFrame:
    """One row, ``bounds``: the raster's with the range of heights, if there is one, as z."""
    low, high = F.coalesce("min_z", flat["min_z"]), F.coalesce("max_z", flat["max_z"])
    return heights.select(bounds(flat["min_x"], flat["min_y"], low, flat["max_x"], flat["max_y"], high).alias("bounds"))


def origin_row(whole: DataFrame, quantum: float = 1.0) -> DataFrame:
    """One row, x, y and z: the local origin of a row of bounds."""
    return whole.select(*[local_origin(F.col("bounds"), a, quantum).alias(a) for a in AXES])


def stage_local(vertices: DataFrame, origin: DataFrame) -> DataFrame:
    """Vertices with x, y, z on a Y-up stage about the local origin, narrowed to floats last.

    The origin is one row: each of its numbers is a scalar subquery, run once.
    """
    x, y, z = (to_local(F.col(f"source_{a}"), origin.select(a).scalar()) for a in AXES)
    return vertices.withColumns({"x": x.cast("float"), "y": z.cast("float"), "z": (-y).cast("float")})


def vertices(samples: DataFrame, width: int, gt: Column, anchor: Column, flat_bounds: Column, policy: str = "skip", **heights) -> DataFrame:
    """The vertices of a window; ``flat_bounds`` are those of the full raster."""
    at = placed(samples, width, gt, anchor, policy, **heights)
    return stage_local(at, origin_row(mesh_bounds(flat_bounds, elevation_range(at, policy))))


def face_keys(samples: DataFrame, width: int, height: int) -> DataFrame:
    """The faces (by their first vertex) that touch a missing sample: up to four for each."""
    c, r = F.col("c"), F.col("r")
    at = [(c + dc, r + dr) for dr in (-1, 0) for dc in (-1, 0)]
    keys = F.array(*[F.when((x >= 0) & (y >= 0) & (x < width - 1) & (y < height - 1), y * width + x) for x, y in at])
    return samples.filter("is_nodata").select(F.explode(keys).alias("face_id")).filter("face_id IS NOT NULL").distinct()


def faces(spark: SparkSession, width: int, height: int, missing: DataFrame | None = None, reverse: bool = True) -> DataFrame:
    """Quads (face_id, v0..v3); ``missing`` are the samples whose faces are left out.

    ``reverse`` is whether the transform's determinant is negative, as for every
    north-up raster: then the order is down, across, up.
    """
    if width * height - 1 > LARGEST_INDEX:
        raise RasterError(Code.AuthoringFailed, "a mesh's vertex index exceeds the integer range")
    across, down = max(0, width - 1), max(0, height - 1)
    row, column = div(F.col("id"), F.lit(max(1, across))), F.col("id") % max(1, across)
    quads = spark.range(across * down).select((row * width + column).alias("face_id"))
    if missing is not None:
        quads = quads.join(face_keys(missing, width, height), "face_id", "left_anti")
    first = F.col("face_id")
    below, right, across_down = first + width, first + 1, first + width + 1
    ring = (first, below, across_down, right) if reverse else (first, right, across_down, below)
    return quads.select("face_id", *[v.alias(f"v{k}") for k, v in enumerate(ring)])


def ranked_faces(quads: DataFrame) -> DataFrame:
    """Faces with their dense position, for a sink that needs it: a sort by range, then counts of the ranges before."""
    from pyspark.sql.window import Window

    ranged = quads.repartitionByRange("face_id").withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("face_id")) - 1
    return ranged.withColumn("_at", inside).join(before, "_part").withColumn("position", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def extent(points: DataFrame) -> DataFrame:
    """One row: the range of the float points, those of skipped cells included, NaN not."""
    sides = [f(F.when(~F.isnan(a), F.col(a))).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    return points.agg(*sides)


def conversion_record(spark: SparkSession, step: int, policy: str, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> DataFrame:
    """What was done to the samples, as one row; fill_value is null unless it was used."""
    row = ("mesh", step, scale, offset, policy, fill if policy == "fill" else None, ORIENTATION, SUBDIVISION)
    names = "representation string, sampling_step int, height_scale double, height_offset double, nodata_policy string, fill_value double, orientation string, subdivision_scheme string"
    return spark.createDataFrame([row], names)


def check_mesh(raster, band: int, width: int, height: int) -> None:
    """Preconditions on a row of ``rasters`` (a mapping or a Row) and on the read window."""
    if not raster["has_gt"] or raster["bounds"] is None or not raster["pixel_anchor"]:
        raise RasterError(Code.AuthoringFailed, "a mesh requires a valid georeferenced raster")
    if not any(b["index"] == band for b in raster["bands"]):
        raise RasterError(Code.AuthoringFailed, "the mesh's band is not present in the source")
    if width < 1 or height < 1:
        raise RasterError(Code.AuthoringFailed, "a mesh requires a window that is not empty")
