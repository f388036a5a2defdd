"""Queries that run as streams over the stored tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import functions as F

from ..streaming import frames as S
from .registry import query

_local: list[str] = []


def _folder(spark) -> str:
    """The shared folder of the session; where there is none, a temporary one, which only a session on one machine may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessera-stream-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


@query("stream_frame_samples", "SELECT event_id // 256 AS frame_id, event_id % 256 AS pos, CAST(floor(least(value, 255)) AS INT) AS v FROM events")
def stream_frame_samples(spark, sf):
    return S.drain(S.frame_samples(S.arriving_events(spark, sf)), _folder(spark))


@query("stream_complete_frames", (
    "SELECT event_id // 256 AS frame_id, sum(CAST(floor(least(value, 255)) AS INT))::BIGINT AS total FROM events GROUP BY 1 HAVING "
    "count(*) = 256"
))
def stream_complete_frames(spark, sf):
    return S.drain(S.complete_frames(S.frame_samples(S.arriving_events(spark, sf))), _folder(spark)).select("frame_id",
        F.col("total").cast("long").alias("total"))
