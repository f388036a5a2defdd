"""Summaries, regressions and validation over benchmark rows (name, category, seconds, pixels, bytes_in, bytes_out, memory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, json_escape


def speed_summary(bench: DataFrame, by: str = "category") -> DataFrame:
    rate = F.col("pixels") / 1e6 / F.col("seconds")
    return bench.groupBy(by).agg(F.avg("seconds").alias("mean_seconds"), F.avg(rate).alias("mean_rate"), F.min("seconds").alias("fastest"),
        F.max("seconds").alias("slowest"), F.min_by("name", F.struct("seconds", "name")).alias("fastest_name"),
            F.max_by("name", F.struct("seconds", "name")).alias("slowest_name"), F.count(F.lit(1)).alias("n"))


def compression_summary(bench: DataFrame) -> DataFrame:
    d = bench.withColumn("ratio", F.col("bytes_in") / F.col("bytes_out"))
    return d.agg(F.max("ratio").alias("best"), F.min("ratio").alias("worst"), F.avg("ratio").alias("mean"),
        F.max_by("name", F.struct("ratio", "name")).alias("best_name"), F.min_by("name", F.struct("ratio", "name")).alias("worst_name"))


def memory_summary(bench: DataFrame) -> DataFrame:
    return bench.agg(F.max("memory").alias("peak"), F.avg("memory").alias("mean"), F.min("memory").alias("least"),
        (F.max("memory") / (F.sum("pixels") / 1e6)).alias("peak_per_megapixel"))


def batch_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"),
        F.avg(F.col("bytes_in") / F.col("bytes_out")).alias("mean_ratio"))


def stage_profile(spans: DataFrame, top: int = 3) -> DataFrame:
    """(stage, seconds): sums, calls, means and shares; the first `top`."""
    d = spans.groupBy("stage").agg(F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("calls"), F.avg("seconds").alias("mean"))
    return d.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy())).orderBy(F.desc("total"), "stage").limit(top)


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two profiles (stage, total, calls) as one: sums of partial sums."""
    return a.unionByName(b).groupBy("stage").agg(F.sum("total").alias("total"), F.sum("calls").alias("calls")).withColumn("mean",
        F.col("total") / F.col("calls"))


def regressions(now: DataFrame, baseline: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Alerts by name: slower by more than the threshold, or compressing less by more than it."""
    d = now.join(baseline.select("name", F.col("seconds").alias("base_seconds"), F.col("ratio").alias("base_ratio")), "name")
    slow = d.where((F.col("base_seconds") > 0) & (F.col("seconds") / F.col("base_seconds") > 1 + threshold))
    slow = slow.select("name", F.lit("time").alias("metric"), F.col("base_seconds").alias("before"), F.col("seconds").alias("after"),
        (F.col("seconds") / F.col("base_seconds") - 1).alias("change"))
    loose = d.where((F.col("ratio") > 0) & (F.col("base_ratio") / F.col("ratio") > 1 + threshold))
    loose = loose.select("name", F.lit("ratio").alias("metric"), F.col("base_ratio").alias("before"), F.col("ratio").alias("after"),
        (F.col("base_ratio") / F.col("ratio") - 1).alias("change"))
    return slow.unionByName(loose)


def throughput_gate(now: DataFrame, baseline: DataFrame, threshold: float = 0.1) -> DataFrame:
    rate = lambda: F.col("pixels") / 1e6 / F.col("seconds")
    d = now.select("name", rate().alias("rate")).join(baseline.select("name", rate().alias("base_rate")), "name")
    return d.withColumn("passed", F.col("rate") >= F.col("base_rate") * (1 - threshold))


# fixed values: the steps of estimated_psnr
def estimated_psnr(ratio: Column) -> Column:
    """A rough step table, for rows without a decoded picture."""
    return F.when(ratio <= 1, 50.0).when(ratio <= 2, 45.0).when(ratio <= 5, 40.0).when(ratio <= 10, 35.0).when(ratio <= 20, 30.0).otherwise(25.0)


def estimated_ssim(psnr: Column) -> Column:
    return clamp(1.0 - F.pow(F.lit(10.0), -(psnr - 20.0) / 20.0), 0.0, 1.0)


def estimated_distance(psnr: Column) -> Column:
    return F.greatest(F.lit(0.0), 15.0 - psnr / 3.0)


def validate(rows: DataFrame, least_psnr: float, least_ssim: float, most_seconds: float) -> DataFrame:
    """(name, psnr, ssim, seconds) with passed and the reasons against, comma-joined."""
    reasons = F.filter(
        F.array(F.when(F.col("psnr") < least_psnr, F.lit("psnr")), F.when(F.col("ssim") < least_ssim, F.lit("ssim")),
            F.when(F.col("seconds") > most_seconds, F.lit("time"))), lambda r: r.isNotNull()
    )
    return rows.withColumn("passed", F.size(reasons) == 0).withColumn("reasons", F.array_join(reasons, ","))


def validation_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    finite = F.when(F.abs("psnr") < float("inf"), F.col("psnr"))
    aggs = [F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean_psnr"), F.coalesce(F.avg("ssim"), F.lit(0.0)).alias("mean_ssim"),
            F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def structure_checks(files: DataFrame) -> DataFrame:
    """(file_id, data): six predicates on a bare stream, and whether all hold."""
    from ..sources.containers import read_image_header

    h = read_image_header(F.col("data"))
    d = files.select("file_id", (F.octet_length("data") > 0).alias("not_empty"), (F.octet_length("data") >= 14).alias("long_enough"),
        (F.hex(F.substring("data", 1, 2)) == "FF0A").alias("signature"),
            *[F.coalesce(e.between(a, b), F.lit(False)).alias(n) for n, e, a,
                b in (("width_ok", h["width"], 1, 262144), ("height_ok", h["height"], 1, 262144), ("channels_ok", h["channels"], 1, 4))])
    return d.withColumn("passed", F.expr("not_empty AND long_enough AND signature AND width_ok AND height_ok AND channels_ok"))


def stream_summary(checked: DataFrame) -> DataFrame:
    """Of structure_checks' rows: streams, passed, failed, how many fail each check, and whether all passed."""
    checks = [c for c in checked.columns if c not in ("file_id", "passed")]
    failing = [F.count_if(~F.col(c)).alias(f"no_{c}") for c in checks]
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), *failing,
        (F.count_if(~F.col("passed")) == 0).alias("all_passed"))


# fixed values: the largest side of a medical frame, its depths and numbers of channels
MEDICAL_SIDE, MEDICAL_DEPTHS, MEDICAL_CHANNELS = 16384, (8, 12, 16, 32), (1, 3)


def medical_checks(frames: DataFrame) -> DataFrame:
    """The first limit of medical pictures that each frame fails, or null."""
    size = F.col("width").cast("long") * F.col("height")
    reason = F.when(F.greatest("width", "height") > MEDICAL_SIDE, "side").when(size > MEDICAL_SIDE * MEDICAL_SIDE, "pixels")
    return frames.withColumn("failed",
        reason.when(~F.col("bits").isin(*MEDICAL_DEPTHS), "bits").when(~F.col("channels").isin(*MEDICAL_CHANNELS), "channels"))


def json_summary(bench: DataFrame, alerts: DataFrame) -> DataFrame:
    """One JSON text: how many rows, their mean seconds and ratio (0 without rows), and how many alerts."""
    mean = lambda c, n: F.format_string(f"%.{n}f", F.coalesce(F.avg(c), F.lit(0.0)))
    d = bench.agg(F.count(F.lit(1)).alias("n"), mean(F.col("seconds"), 6).alias("s"), mean(F.col("bytes_in") / F.col("bytes_out"), 4).alias("r"))
    d = d.crossJoin(alerts.agg(F.count(F.lit(1)).alias("a")))  # one row and one row
    return d.select(F.format_string('{"total":%d,"mean_seconds":%s,"mean_ratio":%s,"regressions":%d}', "n", "s", "r", "a").alias("summary"))


def json_report(bench: DataFrame) -> DataFrame:
    """One JSON text a category, its rows by name; built of bounded groups by aggregation."""
    row = F.concat(F.lit('{"name":"'), json_escape(F.col("name")), F.lit('","bytes":'), F.col("bytes_out").cast("long").cast("string"), F.lit("}"))
    d = bench.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("name", row.alias("j")))).alias("s"))
    return d.select("category", F.concat(F.lit('{"category":"'), json_escape(F.col("category")), F.lit('","results":['),
        F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]}")).alias("report"))


def html_table(bench: DataFrame) -> DataFrame:
    from ..functions.scalar import html_escape

    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("name")), F.lit("</td><td>"), F.col("bytes_out").cast("long").cast("string"),
        F.lit("</td></tr>"))
    d = bench.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("name", row.alias("r")))).alias("s"))
    return d.select("category", F.concat(F.lit("<table>"), F.array_join(F.transform("s", lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))


def series_checks(frames: DataFrame) -> DataFrame:
    """(series, width, height, channels, kind): whether all frames of a series agree."""
    return frames.groupBy("series").agg(F.count(F.lit(1)).alias("frames"),
        (F.count_distinct("width", "height", "channels", "kind") == 1).alias("uniform"))


def frame_checks(frames: DataFrame) -> DataFrame:
    """The first failed limit of each frame, or null: sides 1..262144, 1..4 channels, depth 8, 12, 16 or 32."""
    reason = F.when(~F.col("width").between(1, 262144), "width").when(~F.col("height").between(1, 262144),
        "height").when(~F.col("channels").between(1, 4), "channels").when(~F.col("bits").isin(8, 12, 16, 32), "bits")
    return frames.withColumn("failed", reason)
