"""All queries of the raster operators."""

from . import analysis_queries, coding_queries, pipeline_queries, raster_queries, stream_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis_queries", "coding_queries", "pipeline_queries", "raster_queries", "stream_queries"]
