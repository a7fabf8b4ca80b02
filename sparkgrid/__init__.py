"""sparkgrid: gridded geospatial rasters as Spark DataFrames."""
