"""tessera: raster analytics as Spark DataFrames."""
