from datetime import datetime

from tessera.streaming import frames as S

from .oracle import SF


def test_windows_come_out_once_they_are_closed(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for i, (day, v) in enumerate([(1, 1.0), (1, 3.0), (5, 7.0)]):
        spark.createDataFrame([(i, datetime(2024, 1, day), 0, "a", v)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r.n, r.largest) for r in S.drain(S.window_statistics(stream), f"file://{tmp_path}/out").collect()]
    assert got == [(2, 3.0)]  # the window of the fifth is still open


def test_stream_equals_batch(spark, tmp_path):
    batch = S.frame_samples(spark.read.parquet(f"{SF}/events.parquet"))
    stream = S.drain(S.frame_samples(S.arriving_events(spark, SF)), f"file://{tmp_path}")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
