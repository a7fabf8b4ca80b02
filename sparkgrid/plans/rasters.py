"""Deterministic rasters over ordinary tables, registered as temporary relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.functions.affine import transform, window_bounds
from sparkgrid.functions.windows import div, window
from sparkgrid.operators import grid

#: The raster "dem": 100 columns of event values; errors are missing samples.
WIDTH = 100
NODATA = -9999.0
NORTH_UP = (300000.25, 2.0, 0.0, 4400000.25, 0.0, -2.0)
ROTATED = (300000.0, 1.5, 0.5, 4400000.0, 0.25, -1.75)
ANCHOR = "area"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (i, j, value), of which events of type error are NoData."""
    e = F.col("event_id")
    value = F.when(F.col("event_type") == "error", F.lit(NODATA)).otherwise(F.col("value"))
    return grid.from_table(events(spark, sf_dir), e % WIDTH, div(e, F.lit(WIDTH)), value)


def dem_height(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the dem: a count that Parquet's footers answer."""
    return -(-events(spark, sf_dir).count() // WIDTH)


def dem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dem as read samples, with is_nodata."""
    whole = grid.decode(dem(spark, sf_dir), nodata=NODATA)
    return whole.withColumns({"c": F.col("i"), "r": F.col("j")})


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the embeddings: a vector is a line."""
    return grid.from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), F.col("embedding"))


def gt(rotated: bool = False) -> Column:
    return transform(*(ROTATED if rotated else NORTH_UP))


def flat_bounds(height: int, rotated: bool = False) -> Column:
    return window_bounds(gt(rotated), F.lit(ANCHOR), window(0, 0, WIDTH, height))
