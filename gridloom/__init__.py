"""Raster analytics and table operators on Spark DataFrames."""
