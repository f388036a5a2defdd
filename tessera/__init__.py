"""Raster, block and symbol-stream analytics as PySpark DataFrame operators."""
