"""Frame sequences as streams: what a batch query computes per frame, over events as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def arriving_events(spark: SparkSession, folder: str, name: str = "events", files_each: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(f"{folder}/{name}.parque[t]")


def frame_samples(events: DataFrame, size: int = 256) -> DataFrame:
    """frame, position and clamped sample of each event; stateless, so the same on a table and on a stream."""
    return events.select(F.expr(f"event_id div {size}").alias("frame_id"), (F.col("event_id") % size).alias("pos"),
        F.floor(F.least("value", F.lit(255.0))).cast("int").alias("v"))


def window_statistics(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events, mean and largest value in tumbling windows of event time; state is dropped `late` after a window's end."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.max("value").alias("largest")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "largest")


def complete_frames(samples: DataFrame, size: int = 256, wait: int | None = None) -> DataFrame:
    """A row for each frame once all its samples have come, however they were split over batches: the state of an open
    frame is its count and sum. A frame that gets no sample for `wait` milliseconds is given up."""

    def update(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0)
        for f in frames:
            n, total = n + len(f), total + int(f["v"].sum())
        if n >= size:
            state.remove()
            yield pd.DataFrame({"frame_id": [key[0]], "total": [total]})
        else:
            state.update((n, total))
            if wait:
                state.setTimeoutDuration(wait)

    return samples.groupBy("frame_id").applyInPandasWithState(update, "frame_id long, total long", "n int, total long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet below `folder`, and reads the result."""
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation",
        f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
