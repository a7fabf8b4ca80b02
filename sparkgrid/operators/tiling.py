"""Spatial tiles and levels of detail: planned contracts of the format, built on pixels.

Tiles are anchored at source pixel (0, 0), share the vertices of their high edges
with their neighbours, and are cut at the raster's margins.  Levels decimate by
powers of two until one tile holds the raster; values are never averaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.diagnostics import Code, RasterError
from sparkgrid.functions.windows import div


def tile_name(level: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit("_X"), x.cast("string"), F.lit("_Y"), y.cast("string"))


def payload_path(level: Column, x: Column, y: Column, suffix: str = "usdc") -> Column:
    return F.concat(F.lit("tiles/L"), level.cast("string"), F.lit("/"), x.cast("string"), F.lit("_"), y.cast("string"), F.lit(f".{suffix}"))


def check_tile_size(size: int) -> None:
    if size < 64 or size & (size - 1):
        raise RasterError(Code.InvalidFormatArgument, "tileSize must be a power of two from 64 on")


def shared_edges(vertices: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Vertices (c, r) with each tile they belong to: one, two on a shared edge, or four on a corner."""

    def tiles(at: str, extent: int) -> Column:
        # The last vertex makes no tile of its own: a tile has an edge to span.
        own = F.least(div(F.col(at), F.lit(size)), F.lit(max(0, extent - 2) // size))
        before = F.when((F.col(at) % size == 0) & (F.col(at) > 0) & (own == div(F.col(at), F.lit(size))), own - 1)
        return F.array_compact(F.array(own, before))

    spread = vertices.withColumn("tile_x", F.explode(tiles("c", width)))
    return spread.withColumn("tile_y", F.explode(tiles("r", height)))


def level_sizes(width: int, height: int, size: int) -> list[tuple[int, int, int]]:
    """(level, width, height) from full density to the first level that one tile holds."""
    out = [(0, width, height)]
    while max(out[-1][1], out[-1][2]) > size + 1:
        level, w, h = out[-1]
        out.append((level + 1, -(-w // 2), -(-h // 2)))
    return out


def pyramid(samples: DataFrame, levels: int) -> DataFrame:
    """Samples (c, r, ...) of every level, each sample once for each level that keeps it.

    A sample is on level l if 2^l divides its column and row, so the levels come
    from one pass over the samples and add a third to them.
    """
    both = F.col("c").bitwiseOR(F.col("r"))
    # The lowest set bit of a number is the largest power of two that divides it.
    lowest = both.bitwiseAND(-both)
    depth = F.when(both == 0, F.lit(levels - 1)).otherwise(F.least(F.lit(levels - 1), F.round(F.log2(lowest.cast("double"))).cast("int")))
    spread = samples.withColumn("level", F.explode(F.sequence(F.lit(0), depth)))
    by = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    return spread.withColumns({"c": div(F.col("c"), by), "r": div(F.col("r"), by)})


def manifest(tiled: DataFrame, size: int, keys: tuple[str, ...] = ("level", "tile_x", "tile_y")) -> DataFrame:
    """One row for each tile: name, path, vertex window and count."""
    level, x, y = (F.col(k) for k in keys)
    rows = tiled.groupBy(*keys).agg(
        F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"), F.count(F.lit(1)).alias("vertex_count")
    )
    return rows.withColumns({"tile_name": tile_name(level, x, y), "payload_path": payload_path(level, x, y)})


def write_tiles(tiled: DataFrame, path: str) -> None:
    """Tiles as a partitioned table: a tile's rows are together, and readers prune by tile."""
    tiled.repartition("level", "tile_x", "tile_y").write.partitionBy("level", "tile_x", "tile_y").parquet(path)


def check_image(bands: list) -> None:
    """An image needs three or four bands of bytes; nothing else is guessed to be one."""
    if len(bands) not in (3, 4) or any(b["data_type"] != "uint8" for b in bands):
        raise RasterError(Code.UnsupportedSampleFormat, "an image needs red, green and blue bands of uint8")


def footprint(spark: SparkSession, bounds: Column) -> DataFrame:
    """The extent as a plane of four corners with texture coordinates."""
    corner = lambda x, y, u, v: F.struct(bounds[x].alias("x"), bounds[y].alias("y"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    ring = F.array(corner("min_x", "min_y", 0.0, 0.0), corner("max_x", "min_y", 1.0, 0.0), corner("max_x", "max_y", 1.0, 1.0), corner("min_x", "max_y", 0.0, 1.0))
    return spark.range(1).select(F.posexplode(ring).alias("corner", "p")).select("corner", "p.*")
