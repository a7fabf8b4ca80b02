"""Raster files as relations."""


def register(spark) -> None:
    """Make ``spark.read.format("geogrid")`` known, with filters pushed into it."""
    from sparkgrid.sources.datasource import GeoGridSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoGridSource)
