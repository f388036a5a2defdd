"""Rasters out of tables and generators; containers and files."""
