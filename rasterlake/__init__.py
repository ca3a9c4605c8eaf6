"""Raster-pattern analytics on Spark: 0/1 rasters kept as tables, and the operators over them."""
