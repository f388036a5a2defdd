"""Operators over rasters, blocks, symbols, frames and reports."""
