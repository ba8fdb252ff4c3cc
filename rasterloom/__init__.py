"""Raster analytics on Spark: pixels, blocks, chunks and metadata as DataFrames."""

__version__ = "0.1.0"
