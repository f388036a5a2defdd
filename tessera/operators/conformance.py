"""Whole streams: pictures to bytes and back, vectors that check them, and a harness that measures.

A stream is the image header, a mode byte (0 lossless, 1 lossy), the distance as a double, and the sections of
`coding`, each after its channel, its pass and its length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from ..sources import containers as X
from ..sources import rasters as R
from . import blocks as B
from . import coding as K
from . import metrics as A
from . import prediction as P

HEAD = 14
#: id, category, picture, channels, distance (None: lossless), least PSNR of what is decoded (None: not asked).
VECTORS = (
    ("stream_lossless", "stream", "gradient", 3, None, None),
    ("stream_lossy", "stream", "gradient", 3, 1.0, None),
    ("image_grey", "image", "gradient", 1, None, None),
    ("image_colour", "image", "gradient", 3, None, None),
    ("image_alpha", "image", "gradient", 4, None, None),
    ("frame_lossless", "frame", "pattern", 3, None, None),
    ("frame_lossy", "frame", "pattern", 3, 2.0, None),
    ("bare_lossless", "container", "gradient", 3, None, None),
    ("bare_lossy", "container", "checkerboard", 3, 1.0, None),
    ("exact_gradient", "lossless", "gradient", 3, None, None),
    ("exact_grey", "lossless", "gradient", 1, None, None),
    ("exact_checkerboard", "lossless", "checkerboard", 3, None, None),
    ("exact_noise", "lossless", "noise", 3, None, None),
    ("exact_black", "lossless", "black", 3, None, None),
    ("exact_white", "lossless", "white", 3, None, None),
    ("close_fine", "lossy", "gradient", 3, 0.5, 35.0),
    ("close_middle", "lossy", "gradient", 3, 1.0, 30.0),
    ("close_coarse", "lossy", "pattern", 3, 2.0, 15.0),
)


def encode_lossless(px: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, c, pass and data of each plane."""
    sections = K.plane_sections(P.gradient_predict(px, width), width, height)
    return sections.select("image_id", "c", F.lit(0).alias("pass"), "data")


def encode_lossy(px: DataFrame, width: int, height: int, distance: float) -> DataFrame:
    blocks = B.extract(px, 8, 8, width, height).withColumn("scale", B.adaptive_scale(B.activity(F.col("coef"))))
    return K.block_sections(B.quantise(B.dct(blocks), distance).withColumn("s", B.scan("q", B.zigzag_order())))


def streams(sections: DataFrame, width: int, height: int, distance: float | None) -> DataFrame:
    """image_id and data: a picture's sections behind its header."""
    section = F.concat(X.big_endian(F.col("c"), 1), X.big_endian(F.col("pass"), 1), X.big_endian(F.octet_length("data"), 4), "data")
    d = sections.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "pass", section.alias("b")))).alias("s"),
        F.count_distinct("c").alias("n"))
    one = lambda v: F.lit(v)
    head = X.image_header(one(width), one(height), one(8), F.col("n"), one(0), (F.col("n") % 2 == 0).cast("int"))
    mode = F.lit(struct.pack(">Bd", int(distance is not None), distance or 0.0))
    return d.select("image_id", F.concat(head, mode, F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["b"])), ""))).alias("data"))


def split(files: DataFrame) -> DataFrame:
    """The sections of streams: image_id, distance (null: lossless), c, pass, data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for image, data in zip(frame["image_id"], frame["data"], strict=True):
                reader = K.Reader(bytes(data))
                reader.take(HEAD)
                lossy, distance = struct.unpack(">Bd", reader.take(9))
                while reader.at < len(reader.data):
                    c, p, n = struct.unpack(">BBI", reader.take(6))
                    rows.append((image, distance if lossy else None, c, p, reader.take(n)))
            yield pd.DataFrame(rows, columns=["image_id", "distance", "c", "pass", "data"])

    return files.select("image_id", "data").mapInPandas(run, "image_id long, distance double, c long, pass int, data binary")


def decode_lossless(sections: DataFrame, width: int, height: int) -> DataFrame:
    return P.undo_gradient(K.read_planes(sections, width, height), width, height)


def decode_lossy(sections: DataFrame, width: int, height: int, distance: float, last_pass: int | None = None) -> DataFrame:
    blocks = K.read_blocks(sections, last_pass).withColumn("q", B.unscan("s", B.zigzag_order()))
    back = B.place(B.idct(B.dequantise(blocks, distance)), 8, 8, width, height)
    return back.select("image_id", "c", "y", "x", clamp(F.round("v"), 0.0, 255.0).cast("long").alias("v"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pictures(spark: SparkSession, side: int = 16) -> DataFrame:
    """The vectors' pictures, image_id being the vector's place."""
    made = {
        "gradient": lambda n: R.gradient(spark, side, side, n), "pattern": lambda n: R.pattern(spark, side, side).where(F.col("c") < n),
        "checkerboard": lambda n: R.checkerboard(spark, side, side, 4, n), "noise": lambda n: R.noise(spark, side, side, [42], n),
        "black": lambda n: R.solid(spark, side, side, [0] * n), "white": lambda n: R.solid(spark, side, side, [255] * n),
    }
    row = lambda i, d: d.select(F.lit(i).cast("long").alias("image_id"), *[F.col(k).cast("long").alias(k) for k in ("c", "y", "x")],
        F.col("v").cast("int").alias("v"))
    return _union([row(i, made[v[2]](v[3])) for i, v in enumerate(VECTORS)])


def round_trip(px: DataFrame, of: dict[int, float | None], width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Streams and decoded pixels; of: image_id to its distance. There are few distances, and each is one plan."""
    files, back = [], []
    for distance in sorted(set(of.values()), key=lambda d: (d is not None, d or 0)):
        part = px.where(F.col("image_id").isin([i for i, d in of.items() if d == distance]))
        sections = encode_lossless(part, width, height) if distance is None else encode_lossy(part, width, height, distance)
        files.append(streams(sections, width, height, distance))
        read = split(files[-1]).drop("distance")
        back.append(decode_lossless(read, width, height) if distance is None else decode_lossy(read, width, height, distance))
    return _union(files), _union(back)


def checks(spark: SparkSession, side: int = 16) -> DataFrame:
    """id, category, name and passed: each vector encoded, looked at, decoded and compared."""
    px = pictures(spark, side)
    files, back = round_trip(px, {i: v[4] for i, v in enumerate(VECTORS)}, side, side)
    known = spark.createDataFrame([(i, v[0], v[1], v[3], v[4] is None, v[5]) for i, v in enumerate(VECTORS)],
        "image_id long, id string, category string, channels int, lossless boolean, least double")
    quality = A.psnr(A.align(px, back)).where("c IS NULL").select("image_id", "psnr")
    whole = px.groupBy("image_id").agg(F.count(F.lit(1)).alias("samples"))
    there = back.groupBy("image_id").agg(F.count(F.lit(1)).alias("decoded"))
    d = known.join(files, "image_id", "left").join(quality, "image_id", "left").join(whole, "image_id").join(there, "image_id", "left")
    h, data = X.read_image_header(F.col("data")), F.col("data")
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    found: list[tuple[str, Column]] = [
        ("least_size", size >= 2), ("signature", F.hex(F.substring(data, 1, 2)) == "FF0A"), ("content", size > HEAD + 9),
        ("bare", F.hex(F.substring(data, 5, 4)) != "4A584C20"), ("sides", (h["width"] == side) & (h["height"] == side)),
            ("channels", h["channels"] == F.col("channels")),
        ("frame", F.col("decoded") == F.col("samples")), ("exact", ~F.col("lossless") | (F.col("psnr") == float("inf"))),
        ("psnr", F.col("least").isNull() | (F.col("psnr") >= F.col("least"))),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in found])
    return d.select("id", "category", F.inline(rows))


def summary(checked: DataFrame) -> DataFrame:
    """By category: vectors, checks, and how many of both pass."""
    per = checked.groupBy("category", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"))
    return per.groupBy("category").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("ok") == F.col("n")).alias("vectors_passed"),
        F.sum("n").alias("checks"), F.sum("ok").alias("checks_passed"))


def harness(px: DataFrame, of: dict[int, float | None], width: int, height: int, least_psnr: float, least_ssim: float,
    least_ratio: float) -> DataFrame:
    """image_id, bytes_in, bytes_out, ratio, psnr, ssim, distance, passed: measured on what is decoded, never estimated."""
    files, back = round_trip(px, of, width, height)
    pair = A.align(px, back)
    d = files.select("image_id", F.octet_length("data").cast("long").alias("bytes_out")).join(px.groupBy("image_id").agg(F.count(F.lit(1)).alias("bytes_in")), "image_id")
    d = d.join(A.psnr(pair).where("c IS NULL").select("image_id", "psnr"), "image_id").join(A.ssim(pair, width, height), "image_id")
    d = d.join(A.perceptual_distance(px, back), "image_id").withColumn("ratio", F.col("bytes_in") / F.col("bytes_out"))
    ok = (F.col("psnr") >= least_psnr) & (F.col("ssim") >= least_ssim) & (F.col("ratio") >= least_ratio)
    return d.select("image_id", "bytes_in", "bytes_out", "ratio", "psnr", "ssim", "distance", ok.alias("passed"))
